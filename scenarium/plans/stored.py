"""Queries over files: each writes a format to the shared folder, as a producer would, and reads it through ``sources.files``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scenarium.functions import text as T
from scenarium.operators import metrics, rules
from scenarium.operators.reports import merged
from scenarium.plans import evaluation as E
from scenarium.plans.evaluation_sql import _get, folded
from scenarium.plans.tables import table
from scenarium.sources import files
from scenarium.storage import Scratch


def _folder(spark: SparkSession, name: str) -> str:
    return f"{Scratch(spark, 'stored').root}/{name}"


def manifest_bodies(spark: SparkSession, folder: str) -> DataFrame:
    """A manifest of all conditions, each with a JSON file of its own; the files are found by json_path."""
    root = _folder(spark, "run")
    counts = table(spark, folder, "core_preds").select("pred_id", *[F.coalesce(c, F.lit("")).alias(c) for c in metrics.CONDITION]).distinct().groupBy(*metrics.CONDITION).agg(F.count(F.lit(1)).alias("n"))
    name = F.concat_ws("-", *metrics.CONDITION)
    counts.select(F.to_json(F.struct("n")).alias("value"), F.lower(F.hex(F.encode(name, "utf-8"))).alias("part")).write.partitionBy("part").text(f"{root}/json")
    written = files.whole_texts(spark, f"{root}/json", pattern="*.txt")
    paths = written.select(F.regexp_extract("path", "part=([0-9a-f]*)", 1).alias("part"), "path")
    rows = counts.withColumn("part", F.lower(F.hex(F.encode(name, "utf-8")))).join(paths, "part").select(F.lit("x").alias("image_id"), F.col("path").alias("json_path"), *metrics.CONDITION)
    files.write_csv(rows, f"{root}/manifest", files.MANIFEST)
    told = files.bodies_of(files.manifest(spark, f"{root}/manifest"), written)
    return told.select(*[F.coalesce(c, F.lit("")).alias(c) for c in metrics.CONDITION], F.get_json_object("body", "$.n").cast("bigint").alias("n"))


def stored_object_refs(spark: SparkSession, folder: str) -> DataFrame:
    """Object references of every image through a CSV."""
    root = _folder(spark, "refs")
    refs = E._references(spark, folder).select("image_id", F.array_join("objects", "|").alias("objects"))
    files.write_csv(refs, root)
    return files.object_sets(files.csv_text(spark, root)).select("image_id", F.array_join(F.array_sort("objects"), "|").alias("objects"), F.size("objects").cast("bigint").alias("n"))


def stored_caption_refs(spark: SparkSession, folder: str) -> DataFrame:
    """Caption references, several an image, through a CSV with quotes, commas and line ends in it."""
    root = _folder(spark, "captions")
    rows = E._once(spark, folder, "core_preds", "pred_id").where("caption is not null and image_id is not null and trim(caption) <> ''")
    files.write_csv(rows.select("image_id", F.col("caption").alias("reference_caption")), root)
    got = files.caption_references(files.csv_text(spark, root))
    return got.groupBy("image_id").agg(F.count(F.lit(1)).alias("n"), F.max("ref").alias("last"), F.sum(F.length(F.trim("text"))).alias("chars"))


def _read_dump(spark: SparkSession, rows: DataFrame, schema: str) -> DataFrame:
    root = _folder(spark, "dump.jsonl")
    rows.write.json(root)
    return files.json_array(spark, root, schema)


def _images(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "core_preds").select(F.col("pred_id").cast("string").alias("image_id")).distinct()


def dump_regions(spark: SparkSession, folder: str) -> DataFrame:
    """Region phrases of a dump, of the images wanted."""
    rows = E._once(spark, folder, "core_preds", "pred_id").select(F.col("pred_id").alias("id"), F.array(F.struct(F.col("caption").alias("phrase"))).alias("regions"))
    return files.region_references(_read_dump(spark, rows, files.REGIONS), _images(spark, folder))


def dump_objects(spark: SparkSession, folder: str) -> DataFrame:
    """Object names of a dump in canonical form, of the images wanted."""
    rows = E._once(spark, folder, "groundings", "row_id").where("pred_id is not null").select(F.col("pred_id").alias("image_id"), F.array(F.struct(F.array("visual_label_raw").alias("names"))).alias("objects"))
    return files.object_references(_read_dump(spark, rows, files.OBJECTS), _images(spark, folder), E._aliases())


def dump_relationships(spark: SparkSession, folder: str) -> DataFrame:
    """Relationships of a dump as triples of canonical names."""
    ents = E._once(spark, folder, "entities", "pred_id", "id").select("pred_id", "id", "label")
    acts = E._once(spark, folder, "interactions", "row_id").select("pred_id", "subject_id", "object_id", "verb")
    side = lambda x: ents.select("pred_id", F.col("id").alias(f"{x}_id"), F.struct(F.array("label").alias("names")).alias(x))
    rows = acts.join(side("subject"), ["pred_id", "subject_id"]).join(side("object"), ["pred_id", "object_id"])
    rows = rows.select(F.col("pred_id").alias("image_id"), F.array(F.struct(F.col("verb").alias("predicate"), "subject", "object")).alias("relationships"))
    dump = _read_dump(spark, rows, files.RELATIONSHIPS)
    return files.relationship_references(dump, dump.select(F.col("image_id").cast("string").alias("image_id")), E._aliases(), E._aliases())


def stored_ontology(spark: SparkSession, folder: str) -> DataFrame:
    """The ontology through JSON lines, with its explicit schema."""
    rows = _read_dump(spark, table(spark, folder, "onto_nodes").select("id", "name", "description", "child_ids", "restrictions"), files.ONTOLOGY)
    return rows.select("id", "name", F.array_join("child_ids", "|").alias("child_ids"), F.size("restrictions").cast("bigint").alias("n_restrictions")).distinct()


def stored_run_index(spark: SparkSession, folder: str) -> DataFrame:
    """A run's index of JSON lines; every image once."""
    root = _folder(spark, "index.jsonl")
    rows = table(spark, folder, "pred_files").where("image_id is not null").groupBy("image_id").agg(F.min("json_path").alias("json_path"))
    rows.select(F.to_json(F.struct("image_id", F.concat(F.lit("images/"), "image_id").alias("image_path"), "json_path"))).write.text(root)
    return files.run_index(spark, root).select("image_id", "image_path", "json_path")


def stored_alias_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Aliases through a file of lines: canonical name first."""
    root = _folder(spark, "aliases")
    lines = spark.createDataFrame([(f"{new}, {old}",) for old, new in E.ALIASES.items()], "value string")
    lines.coalesce(1).write.text(root)
    return files.alias_pairs(files.numbered_lines(spark, root)).where("alias <> canonical")


def stored_vocabulary(spark: SparkSession, folder: str) -> DataFrame:
    """Rules through a vocabulary file, resolved to nodes by name; the file has a block that is left out."""
    root = _folder(spark, "vocabulary")
    names = E.ontology_names(spark, folder)
    said = ["# vocabulary", *[f"{name}|{evidence}" for _, name, evidence in E.RULES], "FROM HERE", "Hidden|dog", "TO HERE", "None|no"]
    spark.createDataFrame([("\n".join(said),)], "value string").coalesce(1).write.text(root)
    rows = rules.vocabulary(files.numbered_lines(spark, root))
    own = spark.createDataFrame([(name.lower(), rule_id) for rule_id, name, _ in E.RULES], "name string, id string")
    built = rules.build(rows, own.unionByName(names.join(own.select("name"), "name", "left_anti")))
    return rules.terms_of(built).select("rule_id", F.col("group_no").cast("bigint").alias("group_no"), "term")


def stored_results(spark: SparkSession, folder: str) -> DataFrame:
    """A run's results in their layout, read back: how many of each part."""
    root = _folder(spark, "out")
    rows = E._once(spark, folder, "staged_outputs", "output_id").select(F.col("output_id").cast("string").alias("image_id"), F.col("raw_output").alias("raw"))
    bad = F.when(F.col("raw").isNull(), "no text").when(~F.col("raw").contains("{"), "no object")
    files.write_outputs(rows.select("image_id", "raw", F.col("raw").alias("json"), F.lit("c").alias("caption"), bad.alias("error")), root)
    parts = [spark.read.parquet(f"{root}/{p}").select(F.lit(p).alias("part")) for p in ("raw", "json", "captions")]
    parts += [spark.read.schema("image_id string").json(f"{root}/{p}").select(F.lit(p).alias("part")) for p in ("failed", "manifests")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("part").agg(F.count(F.lit(1)).alias("n"))


def retry_summary(spark: SparkSession, folder: str) -> DataFrame:
    rows = E._once(spark, folder, "staged_outputs", "output_id").select(F.col("output_id").cast("string").alias("image_id"), F.when(F.col("raw_output").isNull(), "no text").alias("error"))
    return files.retry_report(rows, 2)


def merged_metrics(spark: SparkSession, folder: str) -> DataFrame:
    """Per-prediction metrics of several families side by side, columns in order of name, through one CSV."""
    root = _folder(spark, "metrics")
    both = merged(["pred_id"], E.set_prf(spark, folder), E.weighted_prf(spark, folder))
    files.write_csv(files.sorted_union(both, both.limit(0).withColumn("extra", F.lit(None).cast("double"))), root)
    got = files.csv_text(spark, root)
    return got.select(*[F.col(c).cast("bigint" if c == "pred_id" else "double").alias(c) for c in got.columns if c != "extra"])


def detector_terms(spark: SparkSession, folder: str) -> DataFrame:
    """Labels of detector prompts, articles with counts, and data URLs, of all legacy entities."""
    rows = table(spark, folder, "entities").select("label", "count_estimate").where("label is not null").distinct()
    return rows.select(
        "label", "count_estimate", F.array_join(T.prompt_labels(F.concat(F.lit("A "), "label", F.lit("; the "), "label", F.lit(". dog"))), "|").alias("prompt"),
        T.with_article(F.col("label"), F.col("count_estimate")).alias("phrase"), T.data_url(F.encode("label", "utf-8"), F.lit("png")).alias("url"),
    )


def all_prompt_batches(spark: SparkSession, folder: str) -> DataFrame:
    """The leaf terms' batches with the universal one and those of scene groups, with the call's thresholds where it gives some."""
    batches = rules.all_batches(E._term_rows(spark, folder), ["person", "car", "dog", "person"], {"coastal_water": ["boat", "gull"], "none": []}, 0.3, 0.25)
    return rules.effective_thresholds(batches, text=0.2)


QUERIES = {
    f.__name__: f
    for f in (
        manifest_bodies, stored_object_refs, stored_caption_refs, dump_regions, dump_objects, dump_relationships, stored_ontology, stored_run_index, stored_alias_lines, stored_vocabulary,
        stored_results, retry_summary, merged_metrics, detector_terms, all_prompt_batches,
    )
}

_CANON = lambda x: f"coalesce({_get(E.ALIASES, folded(x))}, {folded(x)})"
_PREDS = "(select distinct on (pred_id) * from core_preds)"
SQL = {
    "manifest_bodies": "select coalesce(detector, '') as detector, coalesce(scene_model, '') as scene_model, coalesce(captioner, '') as captioner, count(distinct pred_id) as n from core_preds group by all",
    "stored_object_refs": f"select image_id, string_agg(distinct o, '|' order by o) as objects, count(distinct o) as n from (select image_id, {_CANON('label')} as o from entities where image_id is not null) where o <> '' group by image_id",
    "stored_caption_refs": f"select image_id, count(*) as n, count(*) - 1 as last, sum(len(trim(caption)))::bigint as chars from {_PREDS} where caption is not null and image_id is not null and trim(caption) <> '' group by image_id",
    "dump_regions": f"select pred_id::varchar as image_id, trim(caption) as reference_caption from {_PREDS} where trim(caption) <> ''",
    "dump_objects": f"""select pred_id::varchar as image_id, coalesce(string_agg(distinct o, '|' order by o) filter (o <> ''), '') as objects
from (select pred_id, {_CANON('visual_label_raw')} as o from (select distinct on (row_id) * from groundings)) where pred_id in (select pred_id from core_preds) group by pred_id""",
    "dump_relationships": f"""with e as (select distinct on (pred_id, id) pred_id, id, {_CANON('label')} as l from entities), a as (select distinct on (row_id) pred_id, subject_id, object_id, {_CANON('verb')} as v from interactions),
t as (select a.pred_id, case when s.l <> '' and v <> '' and o.l <> '' then s.l || '::' || v || '::' || o.l end as t from a join e s on s.pred_id = a.pred_id and s.id = a.subject_id join e o on o.pred_id = a.pred_id and o.id = a.object_id)
select pred_id::varchar as image_id, coalesce(string_agg(distinct t, '|' order by t), '') as relationships from t where pred_id is not null group by pred_id""",
    "stored_ontology": "select distinct id, name, array_to_string(child_ids, '|') as child_ids, len(restrictions)::bigint as n_restrictions from (select id, name, description, child_ids, restrictions from onto_nodes)",
    "stored_run_index": "select image_id, 'images/' || image_id as image_path, min(json_path) as json_path from pred_files where image_id is not null group by image_id",
    "stored_alias_lines": "select * from (values " + ", ".join(f"('{a}', '{c}')" for a, c in E.ALIASES.items()) + ") t(alias, canonical)",
    "stored_vocabulary": E.SQL["rule_terms"],
    "stored_results": """with s as (select distinct on (output_id) raw_output as r from staged_outputs) select 'raw' as part, count(r) as n from s union all select 'json', count(*) from s where contains(r, '{')
union all select 'captions', count(*) from s where contains(r, '{') union all select 'manifests', count(*) from s where contains(r, '{') union all select 'failed', count(*) from s where r is null or not contains(r, '{')""",
    "retry_summary": """with s as (select distinct on (output_id) output_id::varchar as image_id, case when raw_output is null then 'no text' end as error from staged_outputs)
select case when error is null then 'succeeded' else 'failed' end as status, image_id, error from s
union all select 'total', null, '{"total_images":' || count(*) || ',"succeeded":' || count(*) filter (error is null) || ',"failed":' || count(error) || ',"max_retries":2}' from s""",
    "merged_metrics": f"select * from ({E.SQL['set_prf']}) a left join ({E.SQL['weighted_prf']}) b using (pred_id)",
    "detector_terms": f"""with r as (select distinct label, count_estimate from entities where label is not null), p as (select *, list_filter(list_transform(regexp_split_to_array('A ' || label || '; the ' || label || '. dog', '[.;,\\n]+'), lambda x: regexp_replace(trim(lower(x)), '^(a|an|the)\\s+', '')), lambda x: x <> '') as l from r),
q as (select *, list_filter(l, lambda x, i: list_position(l, x) = i) as u from p)
select label, count_estimate, array_to_string(u, '|') as prompt, case when count_estimate is null then label when count_estimate > 1 then count_estimate || ' ' || label || 's' when lower(left(label, 1)) in ('a', 'e', 'i', 'o', 'u') then 'an ' || label else 'a ' || label end as phrase,
  'data:image/png;base64,' || to_base64(encode(label)) as url from q""",
    "all_prompt_batches": f"""select *, 0.3::double as box_threshold, 0.2::double as text_threshold from ({E.SQL['prompt_batches']}
union all select 'universal', 3, 'person, car, dog' union all select 'scene:coastal_water', 2, 'boat, gull')""",
}
