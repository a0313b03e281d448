"""Queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scenarium.llm import bpe, cooccur, language, packing, topn, truncation
from scenarium.storage import together

#: Quantile 0.999 of chi-squared with one degree of freedom.
SIGNIFICANT = 10.828


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _normalised(c: str) -> F.Column:
    return F.replace(F.lower(F.trim(F.col(c))), F.lit("_"), F.lit(" "))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """Best detections of each image and label, and best entities of each prediction, in one pass over each table."""
    valid = "confidence between 0 and 1 and not isnan(confidence)"
    none = F.lit(None).cast("string")
    det = _table(spark, folder, "detections").where(valid).select("image_id", _normalised("label").alias("label"), "confidence", "ord", "det_id")
    groups = F.array(F.struct(F.lit("image").alias("level"), F.col("image_id").alias("group_key")), F.struct(F.lit("label").alias("level"), F.when(F.trim("label") != "", F.col("label")).alias("group_key")))
    items = det.select(F.explode(F.filter(groups, lambda g: g["group_key"].isNotNull())).alias("g"), "confidence", "ord", "det_id").select(
        "g.level", "g.group_key", none.alias("item_key"), F.col("confidence").alias("score"), F.col("ord").alias("tie"), F.col("det_id").alias("num")
    )
    ent = _table(spark, folder, "entities").where(valid)
    number = F.regexp_extract("id", r"(\d+)", 1).try_cast("bigint")
    items = items.unionByName(
        ent.select(F.lit("entity").alias("level"), F.col("pred_id").cast("string").alias("group_key"), F.col("id").alias("item_key"), F.col("confidence").alias("score"), F.lit(0).cast("bigint").alias("tie"), number.alias("num"))
    )
    return topn.top_items(items, {"image": 3, "label": 5, "entity": 2})


def _records(spark: SparkSession, folder: str, kind: str) -> DataFrame:
    if kind == "term":
        preds = _table(spark, folder, "core_preds").where("visual_terms is not null").select("pred_id", "visual_terms").dropDuplicates(["pred_id"])
        words = F.transform("visual_terms", lambda t: F.replace(F.lower(F.trim(t)), F.lit("_"), F.lit(" ")))
        return preds.select(F.array_distinct(F.filter(words, lambda t: F.trim(t) != "")).alias("items"))
    nodes = _table(spark, folder, "core_nodes").where("audioset_id is not null").select("pred_id", "audioset_id")
    # As many rows reach a record as it has different items: a set is put together from parts without copies.
    return nodes.groupBy("pred_id").agg(F.collect_set("audioset_id").alias("items")).select("items")


def _pairs(spark: SparkSession, folder: str, **limits: float) -> DataFrame:
    part = lambda kind: cooccur.together(_records(spark, folder, kind), **limits).select(F.lit(kind).alias("kind"), "*")
    found = together(spark, lambda: part("term"), lambda: part("node"))
    return found[0].unionByName(found[1])


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return _pairs(spark, folder).select("kind", "item_a", "item_b")


def p6_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """The pairs with counts, lift and log-likelihood ratio, both rounded to six places."""
    return _pairs(spark, folder).withColumns({"lift": F.round("lift", 6), "llr": F.round("llr", 6)})


def p6_all_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """All pairs of any number and lift, with whether the ratio is significant at one in a thousand."""
    found = _pairs(spark, folder, least=1, lift=0, ratio=-1.0).withColumns({"lift": F.round("lift", 6), "llr": F.round("llr", 4)})
    return found.withColumn("significant", F.col("llr") >= SIGNIFICANT)


def _scored(spark: SparkSession, folder: str) -> DataFrame:
    preds, staged = _table(spark, folder, "core_preds"), _table(spark, folder, "staged_outputs")
    columns = lambda field, key, source, text, most: [F.lit(field).alias("field"), F.col(key).alias("record_id"), F.col(source).alias("source"), F.col(text).alias("text"), most.cast("bigint").alias("most")]
    values = preds.select(*columns("caption", "pred_id", "captioner", "caption", F.lit(None))).unionByName(
        staged.select(*columns("raw_output", "output_id", "model_id", "raw_output", F.col("max_new_tokens")))
    )
    return truncation.scored(values)


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    return truncation.cut_records(_scored(spark, folder))


def p7_rates(spark: SparkSession, folder: str) -> DataFrame:
    return truncation.cut_rates(_scored(spark, folder))


def p8_ids(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.encode(_table(spark, folder, "documents"))


def p9_containers(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(bpe.sizes(_table(spark, folder, "documents")))


def p9_report(spark: SparkSession, folder: str) -> DataFrame:
    return packing.fill_report(p9_containers(spark, folder))


def _judged(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents").select("doc_id", "text", "lang")
    models = language.learn(docs)
    if models is None:
        return spark.createDataFrame([], language.JUDGED)
    return language.documents(docs, models)


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    return language.issues(_judged(spark, folder))


def p10_segments(spark: SparkSession, folder: str) -> DataFrame:
    return language.segments(_judged(spark, folder)).withColumn("confidence", F.round("confidence", 4))


def p10_languages(spark: SparkSession, folder: str) -> DataFrame:
    """Every text with its main language, its confidence and whether it is mixed; null where it has no language."""
    found = _judged(spark, folder)
    best = F.get("languages", F.lit(0))
    many = F.size(F.filter("languages", lambda x: x["sentences"] >= language.MIXED_SENTENCES)) >= 2
    return found.select("doc_id", best["lang"].alias("language"), F.round(best["confidence"], 4).alias("confidence"), F.when(best.isNotNull(), many).alias("mixed"))


def p10_labels(spark: SparkSession, folder: str) -> DataFrame:
    """The languages that labels name, with their rows; those with too few to be learnt are reported as not trained."""
    return language.label_counts(_table(spark, folder, "documents"))


QUERIES = {
    f.__name__: f
    for f in (p2_found, p6_found, p6_pairs, p6_all_pairs, p7_found, p7_rates, p8_ids, p9_containers, p9_report, p10_found, p10_segments, p10_languages, p10_labels)
}

_VALID = "confidence is not null and not isnan(confidence) and confidence between 0 and 1"
_PAIRS = """
with items as (
  select distinct 'term' as kind, pred_id, replace(lower(trim(t)), '_', ' ') as item from core_preds, unnest(visual_terms) as u(t) where trim(t) <> ''
  union all select distinct 'node', pred_id, audioset_id from core_nodes where audioset_id is not null
),
one as (select kind, item, count(*) as n from items group by all),
total as (select kind, count(distinct pred_id) as n from items group by kind),
two as (select a.kind, a.item as item_a, b.item as item_b, count(*) as n_ab from items a join items b on a.kind = b.kind and a.pred_id = b.pred_id and a.item < b.item group by all having count(*) >= 3),
c as (
  select t.kind, item_a, item_b, n_ab, a.n as n_a, b.n as n_b, total.n as n from two t join one a on a.kind = t.kind and a.item = item_a
  join one b on b.kind = t.kind and b.item = item_b join total on total.kind = t.kind where n_ab * total.n >= 3 * a.n * b.n
)
"""
_ALL_PAIRS = _PAIRS.replace(" having count(*) >= 3", "").replace(" where n_ab * total.n >= 3 * a.n * b.n", "")
_H = "(case when {0} > 0 then {0} * ln({0}) else 0 end)"
_LLR = " + ".join(_H.format(x) for x in ("n_ab", "(n_a - n_ab)", "(n_b - n_ab)", "(n - n_a - n_b + n_ab)", "n")) + "".join(" - " + _H.format(x) for x in ("n_a", "n_b", "(n - n_a)", "(n - n_b)"))

SQL = {
    "p2_found": f"""
with d as (select distinct det_id, image_id, ord, confidence, replace(lower(trim(label)), '_', ' ') as label from detections where {_VALID}),
e as (select distinct pred_id, id, confidence, regexp_extract(id, '[0-9]+')::bigint as num from entities where {_VALID})
select * from (
  select 'image' as level, image_id as group_key, det_id::varchar as item_key, row_number() over (partition by image_id order by confidence desc, ord, det_id) as rnk from d where image_id is not null
  qualify rnk <= 3)
union all select * from (
  select 'label', label, det_id::varchar, row_number() over (partition by label order by confidence desc, ord, det_id) as rnk from d where trim(label) <> '' qualify rnk <= 5)
union all select * from (
  select 'entity', pred_id::varchar, id, row_number() over (partition by pred_id order by confidence desc, num) as rnk from e qualify rnk <= 2)
""",
    "p6_found": _PAIRS + "select kind, item_a, item_b from c",
    "p6_all_pairs": _ALL_PAIRS + f"select *, llr >= {SIGNIFICANT} as significant from (select kind, item_a, item_b, n_ab, n_a, n_b, n, round(n_ab::double * n / (n_a::double * n_b), 6) as lift, round(2.0 * ({_LLR}), 4) as llr from c)",
    "p6_pairs": _PAIRS + f"select kind, item_a, item_b, n_ab, n_a, n_b, n, round(n_ab::double * n / (n_a::double * n_b), 6) as lift, round(2.0 * ({_LLR}), 6) as llr from c",
}
