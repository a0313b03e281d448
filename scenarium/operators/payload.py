"""Model payloads: finding JSON in noisy text, normalising and validating it. Errors are data: no row fails a stage."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scenarium import dims
from scenarium.functions.text import label_or, normalised, unit_confidence
from scenarium.functions.variants import elements, once, with_readable

#: Keys that make an object a prediction.
CORE_KEYS = frozenset(
    ["image_id", "scene", "entities", "observed_interactions", "spatial_relations", "environment", "caption", "nodes", "visual_terms"]
)
INDOOR_OUTDOOR = ["indoor", "outdoor", "mixed", "unknown"]
CROWD = ["empty", "sparse", "moderate", "dense", "unknown"]
ACTIVITY = ["low", "medium", "high", "unknown"]
LIGHTING = ["bright", "moderate", "dim", "unknown"]
NODE_TYPES = ["visible_source", "visible_action"]
RELATIONS = ["left_of", "right_of", "above", "below", "overlapping"]
#: Characters of a text that an error quotes.
PREVIEW = 500

_SIGN = re.compile(r'["{}\[\]]|```')
_STRING = re.compile(r'"(?:[^"\\\n]|\\.)*"')


def _braced(text: str, begin: int = 0) -> tuple[str, list[tuple[int, int, bool]], int | None]:
    """(text without commas before a closing bracket, objects as (start, end, whether in a fence), the first brace inside a string).

    One pass over the signs, with a stack of what is open; inside brackets a quoted string is one step. Places stay.
    """
    open_: list[tuple[str, int]] = []
    held = {"{": 0, "[": 0}
    spans: list[tuple[int, int, int]] = []
    commas: list[int] = []
    fences, quoted, m = 0, None, _SIGN.search(text, begin)
    while m:
        sign, at, after = m.group(), m.start(), m.end()
        if sign == "```":
            fences += 1
        elif sign == '"':
            string = _STRING.match(text, at) if open_ else None
            after = string.end() if string else after
            if string and quoted is None and (inside := text.find("{", at, after)) >= 0:
                quoted = inside
        elif sign in "{[":
            open_.append((sign, at))
            held[sign] += 1
        elif held["{" if sign == "}" else "["]:
            before = len(text[begin:at].rstrip()) + begin - 1 if text[at - 1].isspace() else at - 1
            if text[before] == ",":
                commas.append(before)
            while True:  # what was opened inside and not closed goes with it
                kind, start = open_.pop()
                held[kind] -= 1
                if kind == ("{" if sign == "}" else "["):
                    break
            if sign == "}":
                spans.append((start, after, fences))
        m = _SIGN.search(text, after)
    if commas:
        letters = list(text)
        for at in commas:
            letters[at] = " "
        text = "".join(letters)
    fenced = [(start, end, n % 2 == 1 and n < fences) for start, end, n in sorted(spans)]  # a fence must be closed
    return text, fenced, quoted


def _members(value: object) -> Iterator[dict]:
    """The objects inside a JSON value, itself included, from outside in."""
    todo = [value]
    while todo:
        x = todo.pop(0)
        if isinstance(x, dict):
            yield x
            x = list(x.values())
        if isinstance(x, list):
            todo[:0] = x


def _likeness(obj: dict) -> tuple[int, int]:
    """How much an object looks like a prediction: known keys, far more if they are in a core of its own; then all keys."""
    core = obj.get("core")
    known = 100 + len(CORE_KEYS & core.keys()) if isinstance(core, dict) else len(CORE_KEYS & obj.keys())
    return known, len(obj)


def best_object(text: str) -> tuple[str | None, str | None]:
    """(object as JSON, None) or (None, error): of all objects of a text, those inside others too, the one most like a prediction; of
    equal ones the first in a fence, else the first. Objects whose outer braces are never closed, or hold no JSON, count by themselves."""
    best: tuple | None = None
    found, begin = None, 0
    while begin is not None:
        clean, spans, begin = _braced(text, begin)
        done = 0
        for start, end, fenced in spans:
            if start < done:
                continue
            try:
                value = json.loads(clean[start:end])
            except (ValueError, RecursionError):
                continue  # its inner objects come next
            done = end
            for obj in _members(value):
                rank = (*_likeness(obj), fenced)
                if best is None or rank > best:
                    best, found = rank, obj
        if found is not None:  # else a stray quote may have hidden an object: go on from there
            break
    if found is None or best[0] < 1:
        return None, f"no valid JSON object found: {' '.join(text.strip().splitlines())[:PREVIEW]}"
    return json.dumps(found, ensure_ascii=False), None


def extracted(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(key, json, error) of model outputs. Prefix decoding has no built-in, so this is an Arrow function; null text is an error."""
    kind = rows.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [best_object(t) if t is not None else (None, "no text") for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x for x, _ in out], pa.string()), pa.array([e for _, e in out], pa.string())], [key, "json", "error"])

    return rows.select(key, text).mapInArrow(run, f"{key} {kind}, json string, error string")


def schema_kind(core: Column) -> Column:
    """``audioset`` if the core has a member ``nodes``, even an empty one; else ``legacy``."""
    return F.when(F.array_contains(F.map_keys(F.try_variant_get(core, "$", "map<string,variant>")), "nodes"), "audioset").otherwise("legacy")


def _text(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "string")


def with_core(rows: DataFrame, key: str, text: str = "json") -> DataFrame:
    """(key, core, caption): the core of each object, or the object itself; its caption, or the one beside it."""
    here = once(rows.select(key, text), __v=F.try_parse_json(text)).where("__v is not null")
    core = F.coalesce(F.when(F.schema_of_variant(F.try_variant_get("__v", "$.core", "variant")).startswith("OBJECT"), F.try_variant_get("__v", "$.core", "variant")), F.col("__v"))
    here = once(here, core=core, outer=_text(F.col("__v"), "$.caption"))
    return here.select(key, "core", F.coalesce(_text(F.col("core"), "$.caption"), F.col("outer")).alias("caption"))


def scene_of(core: Column) -> Column:
    """A core's scene with defaults: unknown label and place, confidence 0.5."""
    io = label_or(_text(core, "$.scene.indoor_outdoor"), "unknown")
    return F.struct(
        label_or(_text(core, "$.scene.label"), "unknown scene").alias("label"), F.when(io.isin(INDOOR_OUTDOOR), io).otherwise("unknown").alias("indoor_outdoor"),
        unit_confidence(_text(core, "$.scene.confidence"), 0.5).alias("confidence"),
    )


def environment_of(core: Column) -> Column:
    pick = lambda path, allowed: F.when(label_or(_text(core, path), "unknown").isin(allowed), label_or(_text(core, path), "unknown")).otherwise("unknown")
    return F.struct(pick("$.environment.crowd_level", CROWD).alias("crowd_level"), pick("$.environment.activity_level", ACTIVITY).alias("activity_level"), pick("$.environment.lighting", LIGHTING).alias("lighting"))


def with_period(caption: Column) -> Column:
    c = F.coalesce(F.nullif(F.trim(caption), F.lit("")), F.lit("A visual scene."))
    return F.when(c.endswith("."), c).otherwise(F.concat(c, F.lit(".")))


def legacy_entities(cores: DataFrame, key: str) -> DataFrame:
    """(key, id, old_id, label, category, count_estimate, confidence): a legacy core's entities, renumbered in order."""
    rows = cores.select(key, F.posexplode(elements(F.col("core"), "$.entities")).alias("pos", "x")).where(F.schema_of_variant("x").startswith("OBJECT"))
    n = F.row_number().over(Window.partitionBy(key).orderBy("pos"))
    new = F.concat(F.lit("e"), n.cast("string"))
    label = label_or(_text(F.col("x"), "$.label"), "object")
    given = normalised(_text(F.col("x"), "$.category"))
    category = F.when(given.isin(dims.VALID_CATEGORIES), given).otherwise(dims.lookup(dims.CATEGORY_OF, label, dims.DEFAULT_CATEGORY))
    count = F.greatest(F.lit(1).cast("bigint"), F.coalesce(F.try_variant_get("x", "$.count_estimate", "bigint"), F.lit(1).cast("bigint")))
    return rows.withColumn("id", new).select(
        key, "id", F.coalesce(F.nullif(_text(F.col("x"), "$.id"), F.lit("")), "id").alias("old_id"), label.alias("label"), category.alias("category"),
        count.alias("count_estimate"), unit_confidence(_text(F.col("x"), "$.confidence"), 0.5).alias("confidence"),
    )


def legacy_edges(cores: DataFrame, entities: DataFrame, key: str, member: str, word: str, default: str | None, allowed: list[str] | None = None) -> DataFrame:
    """(key, pos, subject_id, word, object_id, confidence) of a core's edges with their ends renumbered.

    Dangling edges, loops and words that are not allowed are dropped. Words are compared normalised, i.e. with ``_`` as a space,
    so of the allowed relations only those of one word are ever found.
    """
    rows = cores.select(key, F.posexplode(elements(F.col("core"), f"$.{member}")).alias("pos", "x")).where(F.schema_of_variant("x").startswith("OBJECT"))
    rows = rows.select(
        key, F.col("pos").cast("bigint").alias("pos"), _text(F.col("x"), "$.subject_id").alias("s"), _text(F.col("x"), "$.object_id").alias("o"),
        label_or(_text(F.col("x"), f"$.{word}"), default or "").alias(word), unit_confidence(_text(F.col("x"), "$.confidence"), 0.5).alias("confidence"),
    )
    # The last entity of an old id stands for it; new ids stand for themselves where no old one is the same.
    ids = entities.select(key, F.col("old_id").alias("ref"), "id", F.lit(0).alias("rank")).unionByName(entities.select(key, F.col("id").alias("ref"), "id", F.lit(1).alias("rank")))
    n = F.regexp_extract("id", "(\\d+)", 1).cast("bigint")
    ids = ids.groupBy(key, "ref").agg(F.min_by("id", F.struct("rank", -n)).alias("new"))
    side = lambda c, out: ids.select(key, F.col("ref").alias(c), F.col("new").alias(out))
    out = rows.join(side("s", "subject_id"), [key, "s"]).join(side("o", "object_id"), [key, "o"]).where("subject_id <> object_id")
    if allowed is not None:
        out = out.where(F.col(word).isin(allowed))
    return out.select(key, "pos", "subject_id", word, "object_id", "confidence")


def audioset_nodes(cores: DataFrame, nodes: DataFrame, terms: DataFrame, key: str) -> DataFrame:
    """(key, node_id, audioset_id, audioset_name, node_type, evidence, terms): a core's nodes that can stand.

    Ids come from ``nodes`` (id, name), by id or by name; evidence is required, and terms must be of the vocabulary (``terms``: term) and, if
    the core declares any, among them. Each id once; renumbered.
    """
    v = F.col("core")
    declared = cores.select(key, F.explode(F.filter(F.transform(elements(v, "$.visual_terms"), lambda t: normalised(F.try_variant_get(t, "$", "string"))), lambda t: t.isNotNull())).alias("term")).join(terms, "term").select(key, "term").distinct()
    raw = cores.select(key, F.posexplode(elements(v, "$.nodes")).alias("pos", "x")).where(F.schema_of_variant("x").startswith("OBJECT"))
    raw = raw.select(
        key, "pos", F.trim(F.coalesce(_text(F.col("x"), "$.audioset_id"), F.lit(""))).alias("given"), label_or(_text(F.col("x"), "$.audioset_name"), "").alias("name"),
        F.trim(F.coalesce(_text(F.col("x"), "$.evidence"), F.lit(""))).alias("evidence"), F.lower(F.trim(F.coalesce(_text(F.col("x"), "$.node_type"), F.lit("visible_source")))).alias("node_type"),
        F.transform(elements(F.col("x"), "$.visual_evidence_terms"), lambda t: normalised(F.try_variant_get(t, "$", "string"))).alias("said"),
    )
    by_id = nodes.select(F.col("id").alias("given"), F.col("name").alias("full"), F.col("id").alias("id1"))
    by_name = nodes.groupBy(normalised(F.col("name")).alias("name")).agg(F.max("id").alias("id2"))
    names = nodes.select(F.col("id").alias("audioset_id"), F.col("name").alias("audioset_name"))
    found = raw.join(by_id, "given", "left").join(by_name, "name", "left").withColumn("audioset_id", F.coalesce("id1", "id2")).where("audioset_id is not null and evidence <> ''")
    cited = found.select(key, "pos", F.posexplode("said").alias("__k", "term")).join(terms, "term")
    any_ = declared.select(key).distinct().withColumn("some", F.lit(True))
    cited = cited.join(any_, key, "left").join(declared.withColumn("own", F.lit(True)), [key, "term"], "left").where("some is null or own")
    kept = cited.groupBy(key, "pos").agg(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("__k", "term"))), lambda x: x["term"])).alias("terms"))
    good = found.join(kept, [key, "pos"])
    first = good.withColumn("i", F.row_number().over(Window.partitionBy(key, "audioset_id").orderBy("pos"))).where("i = 1")
    n = F.row_number().over(Window.partitionBy(key).orderBy("pos"))
    kind = F.when(F.col("node_type").isin(NODE_TYPES), F.col("node_type")).otherwise("visible_source")
    return first.join(names, "audioset_id").select(key, F.concat(F.lit("n"), n.cast("string")).alias("node_id"), "audioset_id", "audioset_name", kind.alias("node_type"), "evidence", "terms")


#: Members a default core may have, and must have.
ALLOWED = {"core": ["image_id", "scene", "visual_terms", "nodes", "caption", "acoustic_caption"], "required": ["image_id", "scene", "nodes", "caption"]}


def core_errors(core: Column) -> Column:
    """ARRAY<STRING> of what a default core violates: unknown and missing members, enums, ranges and patterns."""
    keys = F.map_keys(F.try_variant_get(core, "$", "map<string,variant>"))
    unknown = F.transform(F.array_sort(F.array_except(keys, F.array(*[F.lit(k) for k in ALLOWED["core"]]))), lambda k: F.concat(F.lit("unknown: "), k))
    missing = F.transform(F.array_sort(F.array_except(F.array(*[F.lit(k) for k in ALLOWED["required"]]), keys)), lambda k: F.concat(F.lit("missing: "), k))
    nodes = elements(core, "$.nodes")
    bad = lambda test, text: F.when(test, F.array(F.lit(text))).otherwise(F.array().cast("array<string>"))
    confidence = F.try_variant_get(core, "$.scene.confidence", "double")
    io = _text(core, "$.scene.indoor_outdoor")
    return F.concat(
        unknown, missing, bad(F.coalesce(_text(core, "$.scene.label"), F.lit("")) == "", "scene.label"), bad(io.isNotNull() & ~io.isin(INDOOR_OUTDOOR), "scene.indoor_outdoor"),
        bad(confidence.isNotNull() & ~confidence.between(0, 1), "scene.confidence"),
        bad(F.exists(nodes, lambda x: ~F.coalesce(_text(x, "$.node_id"), F.lit("")).rlike("^n[0-9]+$")), "nodes[].node_id"),
        bad(F.exists(nodes, lambda x: ~F.coalesce(_text(x, "$.audioset_id"), F.lit("")).rlike("^/[mgt]/[a-zA-Z0-9_]+$")), "nodes[].audioset_id"),
        bad(F.exists(nodes, lambda x: ~F.coalesce(_text(x, "$.node_type"), F.lit("")).isin(NODE_TYPES)), "nodes[].node_type"),
        bad(F.exists(nodes, lambda x: ~F.coalesce(F.try_variant_get(x, "$.confidence", "double"), F.lit(0.0)).between(0, 1)), "nodes[].confidence"),
    )


def validation(bodies: DataFrame, key: str) -> DataFrame:
    """Per readable body (key, __v): its kind and counts, and ratios that should be 1 (1 where there is nothing to judge).

    ``__v``: the object as a variant (``functions.variants.with_readable``).
    """
    v = F.col("__v")
    here = once(
        bodies, core=F.try_variant_get("__v", "$.core", "variant"), nodes=elements(v, "$.core.nodes"), boxes=elements(v, "$.extended.grounding"), ents=elements(v, "$.core.entities"),
        acts=elements(v, "$.core.observed_interactions"), said=F.coalesce(F.try_variant_get("__v", "$.core.visual_terms", "array<string>"), F.array().cast("array<string>")),
    )
    texts = lambda c, path: F.array_distinct(F.array_compact(F.transform(c, lambda x: _text(x, path))))
    here = once(here, node_ids=texts("nodes", "$.node_id"), box_ids=texts("boxes", "$.node_id"), entity_ids=texts("ents", "$.id"))
    terms = F.filter(F.transform("nodes", lambda x: F.coalesce(F.try_variant_get(x, "$.visual_evidence_terms", "array<string>"), F.array().cast("array<string>"))), lambda t: F.size(t) > 0)
    here = once(here, terms=terms)
    subset = F.size(F.filter("terms", lambda t: F.size(F.array_except(t, F.col("said"))) == 0))
    valid = F.size(F.filter("acts", lambda x: F.array_contains("entity_ids", _text(x, "$.subject_id")) & F.array_contains("entity_ids", _text(x, "$.object_id")) & (F.coalesce(_text(x, "$.verb"), F.lit("")) != "")))
    share = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(1.0))
    return here.select(
        key, schema_kind(F.col("core")).alias("kind"), F.size("nodes").cast("bigint").alias("n_nodes"), F.size("boxes").cast("bigint").alias("n_grounding"), F.size("ents").cast("bigint").alias("n_entities"),
        F.size("acts").cast("bigint").alias("n_interactions"), (F.size(F.array_except("box_ids", "node_ids")) == 0).alias("grounding_node_id_consistency"),
        share(subset, F.size("terms")).alias("terms_declared_ratio"), share(valid, F.size("acts")).alias("interaction_valid_ratio"),
        (F.coalesce(_text(F.col("core"), "$.caption"), F.lit("")) != "").alias("has_caption"), _text(F.col("core"), "$.scene.label").alias("scene_label"),
    )


def validation_records(rows: DataFrame, key: str, known: DataFrame) -> DataFrame:
    """One row per stored body (key, image_id, body), readable or not: json_valid, json_error, and the figures of its schema (null: of the other one).

    ``known``: (id) of the ontology, for the share of nodes whose id is one of its.
    """
    readable = with_readable(rows.select(key, "body"), "body", "__v")
    figures = validation(readable, key)
    v = F.col("__v")
    more = readable.select(
        key, F.transform(elements(v, "$.core.nodes"), lambda x: F.trim(_text(x, "$.audioset_id"))).alias("ids"), F.array_distinct(F.transform(elements(v, "$.core.entities"), lambda x: _text(x, "$.id"))).alias("own"),
        F.array_distinct(F.transform(elements(v, "$.extended.entities_extended"), lambda x: _text(x, "$.id"))).alias("ext"), F.size(elements(v, "$.extended.entities_extended")).cast("bigint").alias("n_ext"),
        F.size(elements(v, "$.core.visual_terms")).cast("bigint").alias("n_terms"), F.try_variant_get(v, "$.core.scene.confidence", "double").alias("scene_confidence"),
    )
    hits = more.select(key, F.explode("ids").alias("id")).where("id <> ''").join(known.select("id").distinct(), "id", "left_semi").groupBy(key).agg(F.count(F.lit(1)).alias("n_hit"))
    good = figures.join(more, key).join(hits, key, "left")
    audio, legacy = F.col("kind") == "audioset", F.col("kind") == "legacy"
    ratio = F.when(F.col("n_nodes") == 0, 1.0).otherwise(F.coalesce("n_hit", F.lit(0)) / F.col("n_nodes"))
    good = good.select(
        key, "kind", F.when(audio, F.col("n_nodes")).alias("n_nodes"), F.when(audio, F.col("n_grounding")).alias("n_grounding"), F.when(audio, F.col("grounding_node_id_consistency")).alias("grounding_node_id_consistency"),
        F.when(audio, ratio).alias("audioset_id_valid_ratio"), F.when(audio, F.col("terms_declared_ratio")).alias("visual_evidence_terms_subset_of_visual_terms_ratio"), F.when(audio, F.col("n_terms")).alias("n_visual_terms"),
        F.when(legacy, F.col("n_entities")).alias("n_entities"), F.when(legacy, F.col("n_ext")).alias("n_entities_extended"), F.when(legacy, F.col("n_interactions")).alias("n_interactions"),
        F.when(legacy, F.col("interaction_valid_ratio")).alias("interaction_valid_ratio"),
        F.when(legacy, (F.size("ext") == 0) | (F.size(F.array_except("own", "ext")) == 0)).alias("entity_id_consistency"), "has_caption", F.coalesce("scene_label", F.lit("")).alias("scene_label"), "scene_confidence",
    )
    out = rows.select(key, "image_id", F.col("body").isNull().alias("__missing")).join(good, key, "left")
    error = F.when(F.col("kind").isNotNull(), "").when(F.col("__missing"), "no body").otherwise("no readable JSON object")
    return out.withColumns({"json_valid": F.col("kind").isNotNull(), "json_error": error}).drop("__missing")
