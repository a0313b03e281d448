"""Caption metrics: hallucinated objects in two versions, and n-gram consensus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scenarium import dims
from scenarium.functions.text import ascii_folded, segments, singular_phrase, without_scene



def vocabulary(objects: DataFrame, stop_words: list[str]) -> DataFrame:
    """(name): distinct singular names of canonical objects (object), without stop words (in either form) and template words."""
    banned = [*stop_words, *dims.TEMPLATE_WORDS]
    named = objects.select("object", singular_phrase(F.col("object")).alias("name")).where("name <> ''")
    named = named.where(~F.col("object").isin(banned) & ~F.col("name").isin(banned))
    return named.where(~F.arrays_overlap(F.split("name", " "), F.array(*[F.lit(w) for w in dims.TEMPLATE_WORDS]))).select("name").distinct()


def searched(caption: Column, scene: Column) -> Column:
    """A caption as it is searched: segments folded, words singular, the scene's label cut out."""
    return without_scene(singular_phrase(segments(caption)), scene)


def _grams(words: Column, n: int) -> Column:
    """The runs of n words of an array, in order."""
    return _grams_of(words, F.lit(n))


def _lengths(names: DataFrame) -> DataFrame:
    """One row: the numbers of words that names of the vocabulary have."""
    return names.agg(F.coalesce(F.array_sort(F.collect_set(F.size(F.split("name", " ")))), F.array().cast("array<int>")).alias("lengths"))


def _runs_of(words: Column, lengths: Column) -> Column:
    """The runs of an array's words of each length."""
    return F.flatten(F.transform(lengths, lambda n: _grams_of(words, n)))


def _grams_of(words: Column, n: Column) -> Column:
    runs = F.transform(F.sequence(F.lit(1), F.size(words) - n + 1), lambda i: F.array_join(F.slice(words, i, n), " "))
    return F.when(F.size(words) >= n, runs).otherwise(F.array().cast("array<string>"))


def mentions(captions: DataFrame, names: DataFrame, key: str) -> DataFrame:
    """(key, mentioned): names of the vocabulary in each caption, the longest first; what one consumed no other can use.

    ``captions``: key, text (searched). Candidates come from a join of the caption's n-grams with the vocabulary (only lengths
    the vocabulary has), not from trying every name on every caption. The few candidates are then consumed in order inside the
    row: by number of words (descending), then by name.
    """
    words = F.filter(F.split("text", "\\s+"), lambda w: w != "")
    base = captions.select(key, "text", words.alias("w")).join(F.broadcast(_lengths(names)))
    found = base.select(key, F.explode(F.array_distinct(_runs_of(F.col("w"), F.col("lengths")))).alias("name")).join(names, "name")
    order = F.array_sort(F.collect_list(F.struct((-F.size(F.split("name", " "))).alias("n"), "name")))
    candidates = found.groupBy(key).agg(F.transform(order, lambda x: x["name"]).alias("c"))
    rows = captions.join(candidates, key, "left")
    start = F.struct(F.concat(F.lit(" "), F.array_join(words, "  "), F.lit(" ")).alias("t"), F.array().cast("array<string>").alias("m"))

    def consume(acc: Column, name: Column) -> Column:
        # Words are kept apart by two spaces, so that neighbouring hits of one name don't share theirs.
        spaced = F.concat(F.lit(" "), F.replace(name, F.lit(" "), F.lit("  ")), F.lit(" "))
        hit = F.contains(acc["t"], spaced)
        return F.struct(F.when(hit, F.replace(acc["t"], spaced, F.lit(" | "))).otherwise(acc["t"]).alias("t"), F.when(hit, F.concat(acc["m"], F.array(name))).otherwise(acc["m"]).alias("m"))

    done = F.aggregate(F.coalesce("c", F.array().cast("array<string>")), start, consume, lambda acc: acc["m"])
    return rows.select(key, F.array_sort(done).alias("mentioned"))


def mentions_loose(captions: DataFrame, names: DataFrame, key: str) -> DataFrame:
    """(key, mentioned), first version: every name that stands in the folded caption, with or without an ``s``; nothing is consumed.

    Found by joining n-grams, as they are and without a final ``s``, with the names.
    """
    base = captions.select(key, F.filter(F.split(ascii_folded(F.col("text")), " "), lambda w: w != "").alias("w")).join(F.broadcast(_lengths(names)))
    none = F.array().cast("array<string>")
    grams = _runs_of(F.col("w"), F.col("lengths"))
    both = F.array_distinct(F.concat(grams, F.transform(grams, lambda g: F.regexp_replace(g, "s$", ""))))
    found = base.select(key, F.explode(both).alias("name")).where("name <> ''").join(names, "name").groupBy(key).agg(F.array_sort(F.collect_set("name")).alias("mentioned"))
    return captions.select(key).join(found, key, "left").select(key, F.coalesce("mentioned", none).alias("mentioned"))


def chair(mentioned: Column, reference: Column) -> dict[str, Column]:
    """Share of mentioned objects the reference lacks, their number, and the number of mentions; no mention gives zeros."""
    wrong = F.size(F.array_except(mentioned, reference))
    n = F.size(mentioned)
    return {"chair_i": F.when(n == 0, 0.0).otherwise(F.try_divide(wrong.cast("double"), n)), "n_hallucinated": wrong.cast("bigint"), "n_mentioned": n.cast("bigint")}


def chair_means(rows: DataFrame, by: list[str]) -> DataFrame:
    """Per condition: CHAIRi over captions with a mention (null without one), mean mentions and hallucinations over all, n."""
    return rows.groupBy(*by).agg(
        F.avg(F.when(F.col("n_mentioned") > 0, F.col("chair_i"))).alias("chair_i"), F.avg("n_mentioned").alias("avg_mentioned"), F.avg("n_hallucinated").alias("avg_hallucinated"),
        F.count_if(F.col("n_mentioned") > 0).alias("n_chair"), F.count(F.lit(1)).alias("n"),
    )


def chair_report(rows: DataFrame, reference: Column, declared: Column, by: list[str]) -> DataFrame:
    """Per condition: hallucination against the reference and against the prediction's own account (``declared``; null: it has none and
    takes no part there). ``rows``: with mentioned; objects are compared in the singular. Averages of CHAIRi are over captions
    that mention something."""
    singular = lambda c: F.transform(c, singular_phrase)
    vg, own = chair(F.col("mentioned"), singular(F.coalesce(reference, F.array().cast("array<string>")))), chair(F.col("mentioned"), singular(declared))
    some, has = F.size("mentioned") > 0, declared.isNotNull()
    return rows.groupBy(*by).agg(
        F.avg(F.when(some, vg["chair_i"])).alias("CHAIRi_VG"), F.avg(F.when(some & has, own["chair_i"])).alias("CHAIRi_JSON"), F.avg(vg["n_mentioned"]).alias("avg_caption_objects_mentioned"),
        F.avg(vg["n_hallucinated"]).alias("avg_hallucinated_vg"), F.avg(F.when(has, own["n_hallucinated"])).alias("avg_hallucinated_json"), F.count_if(some).alias("n_chair"), F.count(F.lit(1)).alias("n"),
    )


#: Tokens of a caption in the manner of the Penn treebank: numbers, negations and short forms by themselves, words with
#: hyphens; punctuation is no token.
TOKEN = r"[0-9]+(?:[.,:][0-9]+)*|n't\b|'(?:s|re|ve|ll|d|m)\b|[\p{L}\p{N}]+(?:-[\p{L}\p{N}]+)*"
#: Deviation of the penalty for different lengths.
SIGMA = 6.0


def tokens(text: Column, raw: bool = False) -> Column:
    """The words of a caption: of its lower case, without punctuation; ``raw``: what white space separates, as it stands."""
    if raw:
        return F.filter(F.split(text, "\\s+"), lambda w: w != "")
    return F.regexp_extract_all(F.replace(F.lower(text), F.lit("n't"), F.lit(" n't ")), F.lit(TOKEN), F.lit(0))


def ngrams(rows: DataFrame, keys: list[str], most: int) -> DataFrame:
    """(keys, n, gram, tf): counts of the n-grams of ``w``, the words of each row, for all n up to ``most`` in one pass."""
    each = F.flatten(F.array(*[F.transform(_grams(F.col("w"), n), lambda g: F.struct(F.lit(n).alias("n"), g.alias("gram"))) for n in range(1, most + 1)]))  # noqa: B023
    return rows.select(*keys, F.explode(each).alias("__g")).groupBy(*keys, "__g.n", "__g.gram").agg(F.count(F.lit(1)).cast("double").alias("tf"))


def cider(candidates: DataFrame, references: DataFrame, group: list[str], most: int = 4, raw: bool = False) -> DataFrame:
    """(group, id, cider): consensus of each candidate (group, id, image, by, text) with the references (image, by, text) of its image that
    are by others than itself; candidates without any have no row.

    The public scorer's formula, within each group: TF-IDF vectors of n-grams for n = 1..most, documents being the candidates'
    reference sets; per reference, the product of the reference's weights and the candidate's clipped to them, over both
    lengths, times exp(-(difference of bigrams)**2 / (2 * SIGMA**2)); ten times the mean over n and references. A group of
    one candidate scores 0, as every weight is.

    ``references``: one row per image and ``by``. Sparse vectors are rows, and each is joined with its group's document
    frequencies once; work grows with candidates times references of an image, which are as many as there are ``by``.
    """
    n_words = F.greatest(F.size("w") - 1, F.lit(0))
    cands = candidates.withColumn("w", tokens(F.col("text"), raw)).withColumn("bigrams", n_words)
    refs = references.select("image", F.col("by").alias("ref"), tokens(F.col("text"), raw).alias("w")).withColumn("ref_bigrams", n_words)
    here = cands.groupBy(*group, "image", "by").agg(F.count(F.lit(1)).alias("m"))
    met = here.join(refs.select("image", "ref", "ref_bigrams"), "image").where("ref <> `by`").drop("by")
    size = met.select(*group, "image", "m").distinct().groupBy(*group).agg(F.log(F.sum("m").cast("double")).alias("log_n"))
    r = met.select(*group, "image", "m", "ref").join(ngrams(refs, ["image", "ref"], most), ["image", "ref"])
    df = r.select(*group, "image", "m", "n", "gram").distinct().groupBy(*group, "n", "gram").agg(F.sum("m").alias("df"))
    weight = df.join(size, group).select(*group, "n", "gram", (F.col("log_n") - F.log(F.col("df").cast("double"))).alias("idf"))
    r = r.join(weight, [*group, "n", "gram"]).select(*group, "image", "ref", "n", "gram", (F.col("tf") * F.col("idf")).alias("r"))
    c = ngrams(cands, [*group, "id", "image"], most).join(weight, [*group, "n", "gram"], "left").join(size, group)
    c = c.select(*group, "id", "image", "n", "gram", (F.col("tf") * F.coalesce("idf", "log_n")).alias("c"))
    length = lambda x: F.sqrt(F.sum(F.col(x) ** 2))
    r_len = r.groupBy(*group, "image", "ref", "n").agg(length("r").alias("r_len"))
    c_len = c.groupBy(*group, "id", "image", "n").agg(length("c").alias("c_len"))
    dot = c.join(r, [*group, "image", "n", "gram"]).groupBy(*group, "id", "image", "ref", "n").agg(F.sum(F.least("c", "r") * F.col("r")).alias("dot"))
    per = dot.join(r_len, [*group, "image", "ref", "n"]).join(c_len, [*group, "id", "image", "n"])
    per = per.select(*group, "id", "image", "ref", F.coalesce(F.try_divide("dot", F.col("r_len") * F.col("c_len")), F.lit(0.0)).alias("v"))
    per = per.groupBy(*group, "id", "image", "ref").agg(F.sum("v").alias("v"))
    pairs = cands.select(*group, "id", "image", "bigrams").join(met.select(*group, "image", "ref", "ref_bigrams"), [*group, "image"])
    gap = (F.col("bigrams") - F.col("ref_bigrams")).cast("double")
    value = F.coalesce("v", F.lit(0.0)) * F.exp(-(gap**2) / (2 * SIGMA**2)) / most
    return pairs.join(per, [*group, "id", "image", "ref"], "left").groupBy(*group, "id").agg((10.0 * F.avg(value)).alias("cider"))
