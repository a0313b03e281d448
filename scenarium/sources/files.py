"""The file formats the engine reads and writes. Readers take explicit schemas: nothing is inferred, ids stay text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scenarium.functions.text import ascii_folded, canonical, scene_label

MANIFEST = ["image_id", "json_path", "detector", "scene_model", "captioner"]


def csv_text(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """A CSV with a header, all columns as text."""
    return spark.read.option("header", True).option("inferSchema", False).option("multiLine", True).option("escape", '"').csv(path)


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """A prediction manifest; fails, naming them, on missing columns."""
    rows = csv_text(spark, path)
    missing = [c for c in MANIFEST if c not in rows.columns]
    if missing:
        raise ValueError(f"manifest lacks {', '.join(missing)}")
    return rows


def whole_texts(spark: SparkSession, paths: str | list[str], pattern: str = "*.json", recursive: bool = True) -> DataFrame:
    """(path, body) of files, one row each."""
    reader = spark.read.option("wholetext", True).option("pathGlobFilter", pattern).option("recursiveFileLookup", recursive)
    return reader.text(paths).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("body"))


def bodies_of(manifest_rows: DataFrame, files: DataFrame) -> DataFrame:
    """Manifest rows with the body of their json_path (null where there is no such file); paths compare without a scheme."""
    bare = lambda c: F.regexp_replace(c, "^file:/+", "/")
    right = files.select(bare(F.col("path")).alias("__p"), "body")
    return manifest_rows.withColumn("__p", bare(F.col("json_path"))).join(right, "__p", "left").drop("__p")


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, line_no, line) of text files, numbered within each file from 0."""
    text = spark.read.option("wholetext", True).text(path).select(F.col("_metadata.file_path").alias("path"), F.posexplode(F.split("value", "\\r?\\n")).alias("line_no", "line"))
    return text.select("path", F.col("line_no").cast("bigint").alias("line_no"), "line")


def positioned(rows: DataFrame, name: str = "__at") -> DataFrame:
    """``rows`` as read from files with their place: greater in later rows of a file. To be taken before any shuffle."""
    return rows.withColumn(name, F.monotonically_increasing_id())


def object_sets(refs: DataFrame, order: Column | None = None) -> DataFrame:
    """(image_id, objects): ``|``-joined names as distinct arrays without empty ones; of repeated ids the last row stands, or the last by ``order``."""
    items = F.array_distinct(F.filter(F.split("objects", "\\|"), lambda x: x != ""))
    return positioned(refs).groupBy("image_id").agg(F.max_by(items, order if order is not None else F.col("__at")).alias("objects"))


def relation_sets(refs: DataFrame, order: Column | None = None) -> DataFrame:
    """(image_id, triples): ``s::p::o`` items joined by ``|`` as distinct structs; items that have not three parts are dropped. As for ``object_sets``
    the last row stands."""
    parts = F.filter(F.transform(F.split("relationships", "\\|"), lambda x: F.split(x, "::")), lambda p: F.size(p) == 3)
    triples = F.array_distinct(F.transform(parts, lambda p: F.struct(p[0].alias("subject"), p[1].alias("predicate"), p[2].alias("object"))))
    return positioned(refs).groupBy("image_id").agg(F.max_by(triples, order if order is not None else F.col("__at")).alias("triples"))


def caption_references(refs: DataFrame) -> DataFrame:
    """(image_id, ref, text): a row per reference, numbered within its image in the order of rows."""
    w = Window.partitionBy("image_id").orderBy("__at")
    return positioned(refs).select("image_id", (F.row_number().over(w) - 1).cast("bigint").alias("ref"), F.col("reference_caption").alias("text"))


def alias_pairs(lines: DataFrame) -> DataFrame:
    """(alias, canonical) of alias lines (line_no, line): ``canonical,alias,...``, folded; later lines overwrite earlier ones."""
    parts = lines.select("line_no", F.filter(F.transform(F.split("line", ","), ascii_folded), lambda x: x != "").alias("p")).where("size(p) > 0")
    rows = parts.select("line_no", F.posexplode("p").alias("k", "alias"), F.get("p", F.lit(0)).alias("canonical"))
    return rows.groupBy("alias").agg(F.max_by("canonical", F.struct("line_no", "k")).alias("canonical"))


REGIONS = "id bigint, image_id bigint, regions array<struct<phrase:string>>"
OBJECTS = "image_id bigint, objects array<struct<names:array<string>>>"
RELATIONSHIPS = "image_id bigint, relationships array<struct<predicate:string,subject:struct<names:array<string>>,object:struct<names:array<string>>>>"
ONTOLOGY = "id string, name string, description string, child_ids array<string>, restrictions array<string>"


def json_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of a JSON array (or of JSON lines, which any number of tasks can read)."""
    return spark.read.schema(schema).option("multiLine", not path.endswith("l")).json(path)


def region_references(dump: DataFrame, images: DataFrame) -> DataFrame:
    """(image_id, reference_caption): each non-empty phrase of the images wanted. The id is ``id``, else ``image_id``."""
    rows = dump.select(F.coalesce("id", "image_id").cast("string").alias("image_id"), "regions").join(images.select("image_id").distinct(), "image_id", "left_semi")
    return rows.select("image_id", F.explode("regions.phrase").alias("p")).select("image_id", F.trim("p").alias("reference_caption")).where("reference_caption <> ''")


def object_references(dump: DataFrame, images: DataFrame, aliases: Column) -> DataFrame:
    """(image_id, objects): sorted distinct canonical names joined by ``|``; images without objects have empty text."""
    rows = dump.select(F.col("image_id").cast("string").alias("image_id"), F.flatten("objects.names").alias("n")).join(images.select("image_id").distinct(), "image_id", "left_semi")
    names = F.filter(F.transform("n", lambda x: canonical(x, aliases)), lambda x: x != "")
    return rows.groupBy("image_id").agg(F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list(names)))), "|").alias("objects"))


def relationship_references(dump: DataFrame, images: DataFrame, objects: Column, predicates: Column) -> DataFrame:
    """(image_id, relationships): sorted distinct ``s::p::o`` of every pair of names an edge has, joined by ``|``."""
    rows = dump.select(F.col("image_id").cast("string").alias("image_id"), F.explode_outer("relationships").alias("r")).join(images.select("image_id").distinct(), "image_id", "left_semi")
    rows = rows.select("image_id", canonical(F.col("r.predicate"), predicates).alias("p"), F.explode_outer("r.subject.names").alias("s"), F.col("r.object.names").alias("os"))
    rows = rows.select("image_id", "p", canonical(F.col("s"), objects).alias("s"), F.explode_outer("os").alias("o")).withColumn("o", canonical(F.col("o"), objects))
    triple = F.when((F.col("s") != "") & (F.col("p") != "") & (F.col("o") != ""), F.concat_ws("::", "s", "p", "o"))
    return rows.groupBy("image_id").agg(F.array_join(F.array_sort(F.collect_set(triple)), "|").alias("relationships"))


def scene_categories(lines: DataFrame) -> DataFrame:
    """(number, label) of a category file's lines: ``/a/name 0``."""
    path = F.regexp_extract("line", "^/[a-z]/(\\S+)\\s+\\d+$", 1)
    return lines.where("line rlike '^/[a-z]/\\\\S+\\\\s+\\\\d+$'").select(F.regexp_extract("line", "(\\d+)$", 1).cast("bigint").alias("number"), scene_label(path).alias("label"))


def images(spark: SparkSession, folder: str, patterns: str = "*.jpg", limit: int | None = None) -> DataFrame:
    """(path, content) of a folder's images; ``limit`` is the caller's wish for the first ones by path. Only paths are sorted, never contents."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", patterns).load(folder)
    rows = files.select("path", "content")
    return rows if limit is None else rows.join(files.select("path").orderBy("path").limit(limit), "path", "left_semi")


def image_paths(ids: DataFrame, listing: DataFrame) -> DataFrame:
    """(image_id, path): the id's file, ``.jpg`` before ``.jpeg`` before ``.png``; null where there is none."""
    name = F.regexp_extract("path", "([^/]+)\\.(jpg|jpeg|png)$", 1)
    rank = F.array_position(F.array(F.lit("jpg"), F.lit("jpeg"), F.lit("png")), F.regexp_extract("path", "\\.([a-z]+)$", 1))
    found = listing.select(name.alias("image_id"), "path", rank.alias("rank")).where("rank > 0").groupBy("image_id").agg(F.min_by("path", "rank").alias("path"))
    return ids.select("image_id").distinct().join(found, "image_id", "left")


def run_index(spark: SparkSession, path: str) -> DataFrame:
    """(image_id, image_path, json_path, caption_path) of JSON lines; of repeated ids the last line stands. Any number of tasks reads a log."""
    lines = positioned(spark.read.text(path)).where("value <> ''")
    rows = lines.withColumn("j", F.from_json("value", "image_id string, image_path string, json_path string, caption_path string"))
    return rows.where("j.image_id is not null").groupBy("j.image_id").agg(F.max_by("j", "__at").alias("j")).select("j.*")


def write_csv(rows: DataFrame, path: str, columns: list[str] | None = None) -> None:
    """One CSV with a header and a fixed order of columns, quotes doubled and white space kept; an error if there are no rows."""
    rows = rows.select(columns or rows.columns)
    if rows.isEmpty():
        raise ValueError("no rows to write")
    rows.coalesce(1).write.mode("overwrite").options(header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)


def sorted_union(*tables: DataFrame) -> DataFrame:
    """Tables of different columns as one, columns in order of name, absent ones null."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out.select(sorted(out.columns))


def write_outputs(results: DataFrame, folder: str) -> None:
    """Results (image_id, raw, json, caption, error) in the layout of a run: raw, json and captions of the good ones, failed with their errors."""
    good, bad = results.where("error is null"), results.where("error is not null")
    results.where("raw is not null").select("image_id", "raw").write.mode("overwrite").parquet(f"{folder}/raw")
    good.select("image_id", "json").write.mode("overwrite").parquet(f"{folder}/json")
    good.select("image_id", "caption").write.mode("overwrite").parquet(f"{folder}/captions")
    bad.select("image_id", "error", F.concat(F.lit("raw/"), "image_id").alias("raw_path")).write.mode("overwrite").json(f"{folder}/failed")
    good.select("image_id", F.concat(F.lit("json/"), "image_id").alias("json_path"), F.concat(F.lit("captions/"), "image_id").alias("caption_path")).write.mode("overwrite").json(f"{folder}/manifests")


def retry_report(results: DataFrame, max_retries: int) -> DataFrame:
    """(status, image_id, error): a row per image that succeeded or failed, and one of ``total`` whose error column holds the totals as JSON.
    Ids stay rows, however many there are."""
    each = results.select(F.when(F.col("error").isNull(), "succeeded").otherwise("failed").alias("status"), "image_id", "error")
    totals = results.agg(F.to_json(F.struct(F.count(F.lit(1)).alias("total_images"), F.count_if(F.col("error").isNull()).alias("succeeded"), F.count("error").alias("failed"), F.lit(max_retries).alias("max_retries"))).alias("error"))
    return totals.select(F.lit("total").alias("status"), F.lit(None).cast("string").alias("image_id"), "error").unionByName(each)
