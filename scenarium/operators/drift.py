"""Schemas that drift between files: one consistent table, and a report of each change.

The catalogue plays the part of file footers: per producer, batch and field, the set of JSON types (and the kinds of
values) seen. Over it, lag and lead find the islands of consecutive batches in which a producer has a field with a type;
where islands start and end, fields were added, removed, renamed or changed their type. An alias table pairs old and new
names, and gives the casts that bring every version into one table.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scenarium.functions.variants import absent, json_type, kind, once, with_readable
from scenarium.storage import Scratch


@dataclass(frozen=True)
class Vocabulary:
    """What is known beforehand of the bodies: a parameter of every operator here. Names it lacks are dealt with, too:
    they fall to the kinds and values they hold, and to the consistent table's ``rest``.

    fields is the alias table: name -> (column of the consistent table, form of its values, other names producers have used).
    Casts are generated from it: a column is cast by its form; of several names of one column, the earlier stand first.
    """

    containers: dict[str, list[str]] = field(default_factory=dict)
    captions: dict[str, list[str]] = field(default_factory=dict)
    fields: dict[str, tuple[str, str, list[str]]] = field(default_factory=dict)
    #: Members of ``core`` that hold neither elements nor the acoustic caption.
    other_parts: tuple[str, ...] = ()
    #: Pattern of the names of an acoustic caption that no alias names.
    caption_name: str = "acoustic|audio|sound"

    def names(self) -> Column:
        """MAP of each known name to the one it stands for."""
        tables = [self.containers, self.captions, {name: olds for name, (_, _, olds) in self.fields.items()}]
        return _name_map(*tables)

    def columns(self) -> dict[str, tuple[Callable[[Column], Column], list[str]]]:
        """Column -> (cast, names of its fields)."""
        out: dict[str, tuple[Callable[[Column], Column], list[str]]] = {}
        for name, (column, form, _) in self.fields.items():
            out.setdefault(column, (CASTS[form], []))[1].append(name)
        return out


def _name_map(*tables: dict[str, list[str]]) -> Column:
    pairs = {old: new for table in tables for new, olds in table.items() for old in [new, *olds]}
    return F.create_map(*[F.lit(x) for pair in pairs.items() for x in pair]) if pairs else F.create_map().cast("map<string,string>")


#: The names of these producers' bodies.
KNOWN = Vocabulary(
    containers={"nodes": ["audioset_nodes", "semantic_nodes"], "entities": ["instances", "objects"]},
    captions={"acoustic_caption": ["audio_description", "sound_caption"]},
    fields={
        "node_id": ("id", "text", ["nid", "local_id"]),
        "id": ("id", "text", ["eid", "entity_id"]),
        "audioset_name": ("label", "text", ["title", "display_name"]),
        "label": ("label", "text", ["name", "class_name"]),
        "node_type": ("category", "text", ["kind", "inference_type"]),
        "category": ("category", "text", ["group", "super_category"]),
        "evidence": ("evidence", "text", ["evidence_text", "rationale"]),
        "confidence": ("confidence", "number", ["conf", "score", "probability"]),
        "count_estimate": ("count_estimate", "number", ["count", "n_instances"]),
        "visual_evidence_terms": ("terms", "list", ["cited_terms", "evidence_terms"]),
        "parent_ids": ("parent_ids", "list", ["parents", "parentIds"]),
        "top_level_ids": ("top_level_ids", "list", ["roots", "topLevelIds"]),
        "audioset_id": ("audioset_id", "text", ["mid", "ontology_id"]),
        "aliases": ("aliases", "list", []),
        "area_ratio": ("area_ratio", "number", []),
        "attributes": ("attributes", "list", []),
        "bbox": ("bbox", "numbers", []),
        "evidence_span": ("evidence_span", "span", []),
        "instance_count": ("instance_count", "number", []),
        "is_abstract": ("is_abstract", "flag", []),
        "is_crowd": ("is_crowd", "flag", []),
        "mask_rle": ("mask_rle", "span", []),
        "rank_in_image": ("rank_in_image", "number", []),
        "rule_name": ("rule_name", "text", []),
        "salience": ("salience", "number", []),
        "source": ("source", "text", []),
        "track_id": ("track_id", "text", []),
    },
    other_parts=("image_id", "scene", "visual_terms", "caption", "observed_interactions", "spatial_relations", "environment"),
)
#: Shared kinds of values, as a part of all kinds seen, from which a field under an unknown name counts as the same one.
SAME_KIND = 0.5
#: Batches in one window: longer histories are cut into blocks that overlap by one batch.
BLOCK = 4096


def core_parts(files: DataFrame, keys: list[str], body: str = "body", known: Vocabulary = KNOWN) -> DataFrame:
    """(keys, name, value, family, elements): the members of ``core`` that are looked at, of every readable body.

    family is ``caption`` for the acoustic caption and ``nodes`` or ``entities`` (else the member's own name) for a container; elements
    are a container's members, whether it is an array or an object. A member under an unknown name is a container if it
    holds objects, and the acoustic caption if its name speaks of sound and it doesn't.
    """
    here = with_readable(files.select(*keys, F.col(body).alias("__body")), "__body", "__v")
    here = here.select(*keys, F.explode(F.map_entries(F.try_variant_get("__v", "$.core", "map<string,variant>"))).alias("__e"))
    here = here.select(*keys, F.col("__e.key").alias("name"), F.col("__e.value").alias("value"))
    here = here.where(~F.col("name").isin(*known.other_parts) & ~absent(F.col("value")))
    listed = F.coalesce(F.try_variant_get("value", "$", "array<variant>"), F.map_values(F.try_variant_get("value", "$", "map<string,variant>")))
    here = once(here, elements=F.when(kind(F.col("value")).isin("ARRAY", "OBJECT"), listed))
    container = F.element_at(_name_map(known.containers), F.col("name"))
    said = F.element_at(_name_map(known.captions), F.col("name"))
    holds_objects = F.exists("elements", lambda x: kind(x) == "OBJECT")
    family = (
        F.when(said.isNotNull(), "caption")
        .when(container.isNotNull(), container)
        .when(holds_objects, F.col("name"))
        .when(F.lower("name").rlike(known.caption_name), "caption")
    )
    return here.withColumn("family", family).where("family is not null")


def value_kind(v: Column) -> Column:
    """A coarse kind of a value, by which a field is known under another name."""
    text = F.try_variant_get(v, "$", "string")
    number = F.try_variant_get(v, "$", "double")
    of_text = (
        F.when(text.rlike(r"^/"), "path")
        .when(text.rlike(r"^[A-Za-z]+-?\d+$"), "id")
        .when(text.rlike(r"^\S+_\S+$"), "code")
        .when(text.rlike(r"^\S*$"), "word")
        .when(text.rlike(r"[.!?…。]\s*$"), "sentence")
        .otherwise("phrase")
    )
    of_number = F.when(number != F.floor(number), "fraction").when(number.between(0, 1), "bit").otherwise("count")
    t = json_type(v)
    shape = F.regexp_replace(F.schema_of_variant(v), r"DECIMAL\(\d+,\d+\)|BIGINT|DOUBLE", "NUMBER")
    inner = F.concat(t, F.lit(":"), F.hex(F.xxhash64(shape)))  # of the whole shape, however long
    return F.when(t == "string", of_text).when(t == "number", of_number).when(t == "boolean", "flag").otherwise(inner)


def catalogue(files: DataFrame, keys: list[str], body: str = "body", known: Vocabulary = KNOWN) -> DataFrame:
    """(keys, parent, path, type, kinds): every field seen with a non-null value, its JSON types and kinds of values.

    One row per keys, path and type; aggregated before it is shuffled, so that a batch of any size (and a repeated
    delivery) costs one row per field and task. parent is the container's path, ``''`` for what stands in ``core``.
    """
    parts = core_parts(files, keys, body, known)
    top = F.array(F.struct(F.lit("").alias("parent"), F.col("name").alias("path"), json_type(F.col("value")).alias("type"), F.when(F.col("family") == "caption", F.lit("caption")).otherwise("container").alias("kind")))
    # An element that is no object gives null; the members of the others must not be lost with it.
    members = F.flatten(F.filter(F.transform(F.when(F.col("family") != "caption", F.col("elements")), lambda x: _members(x)), lambda m: m.isNotNull()))
    rows = parts.select(*keys, F.explode(F.array_distinct(F.concat(top, F.coalesce(members, F.array().cast(_MEMBER))))).alias("f")).select(*keys, "f.*")
    return rows.groupBy(*keys, "parent", "path", "type").agg(F.collect_set("kind").alias("kinds"))


_MEMBER = "array<struct<parent:string,path:string,type:string,kind:string>>"


def _members(x: Column) -> Column:
    pairs = F.map_entries(F.try_variant_get(x, "$", "map<string,variant>"))
    return F.transform(
        F.filter(pairs, lambda e: ~absent(e["value"])),
        lambda e: F.struct(F.col("name").alias("parent"), F.concat(F.col("name"), F.lit("[]."), e["key"]).alias("path"), json_type(e["value"]).alias("type"), value_kind(e["value"]).alias("kind")),
    )


def ordinals(batches: DataFrame) -> DataFrame:
    """``batches`` (producer, batch_id, first_at) with ``n``: 1, 2, ... by first_at (ties: batch_id) within a producer.

    Counted per day and added up over days, so that no window holds all batches of a producer. A missing first_at sorts
    before all others.
    """
    day = F.coalesce(F.date_trunc("day", "first_at").cast("string"), F.lit(""))
    here = batches.withColumn("__day", day)
    per_day = here.groupBy("producer", "__day").agg(F.count(F.lit(1)).alias("k"))
    before = Window.partitionBy("producer").orderBy("__day").rowsBetween(Window.unboundedPreceding, -1)
    per_day = per_day.withColumn("before", F.coalesce(F.sum("k").over(before), F.lit(0))).drop("k")
    inside = Window.partitionBy("producer", "__day").orderBy(F.col("first_at").asc_nulls_first(), "batch_id")
    here = here.withColumn("__i", F.row_number().over(inside))
    return here.join(per_day, ["producer", "__day"]).withColumn("n", (F.col("before") + F.col("__i")).cast("bigint")).drop("__day", "__i", "before")


def islands(present: DataFrame, keys: list[str], n: str = "n", block: int = BLOCK) -> DataFrame:
    """``present`` with ``starts`` and ``ends``: whether the row's n is the first or the last of a run of consecutive n.

    Within blocks of ``block`` numbers; the first and last of a block are shown to its neighbours too.
    """
    at = F.floor(F.col(n) / block)
    own = present.withColumn("__b", at).withColumn("__own", F.lit(True))
    later = present.where(F.col(n) % block == block - 1).withColumn("__b", at + 1).withColumn("__own", F.lit(False))
    earlier = present.where(F.col(n) % block == 0).withColumn("__b", at - 1).withColumn("__own", F.lit(False))
    w = Window.partitionBy(*keys, "__b").orderBy(n)
    seen = own.unionByName(later).unionByName(earlier).withColumns({"__p": F.lag(n).over(w), "__n": F.lead(n).over(w)})
    seen = seen.withColumns({"starts": F.coalesce(F.col("__p") != F.col(n) - 1, F.lit(True)), "ends": F.coalesce(F.col("__n") != F.col(n) + 1, F.lit(True))})
    return seen.where("__own").drop("__b", "__own", "__p", "__n")


def changes(files: DataFrame, block: int = BLOCK, known: Vocabulary = KNOWN) -> DataFrame:
    """(producer, batch_id, field, change, new_field): what differs between each batch of a producer and the one before.

    ``files``: producer, batch_id, body, written_at. Batches are ordered by their earliest written_at, ties by batch_id;
    a producer's first batch has no changes. change is ``added``, ``removed``, ``renamed`` or ``type``. A changed container
    gives one row and none for its fields. Rows without producer or batch_id are left out; a batch without a readable
    body lost all its fields. Empty input gives no rows.

    Renames are paired one to one, the most alike first, until no pair is left: two names of the alias table for one field,
    then fields of which a name is unknown, by the part of their kinds of values they share and, where fields compete, of their values.
    """
    files = files.where("producer is not null and batch_id is not null")
    batch = ["producer", "batch_id"]
    order = ordinals(files.groupBy(*batch).agg(F.min("written_at").alias("first_at"))).select(*batch, "n")
    scratch = Scratch(files.sparkSession, "drift")
    order = scratch.write(order, "order")
    last = order.groupBy("producer").agg(F.max("n").alias("last"))
    seen = scratch.write(catalogue(files, batch, known=known).join(order, batch), "catalogue")
    runs = islands(seen.select("producer", "parent", "path", "type", "n"), ["producer", "path", "type"], block=block)
    begun = runs.where("starts and n > 1").select("producer", "parent", "path", "n")
    ended = runs.where("ends").join(last, "producer").where("n < last").select("producer", "parent", "path", (F.col("n") + 1).alias("n"))
    touched = begun.unionByName(ended).distinct()
    sets = seen.groupBy("producer", "path", "n").agg(F.array_sort(F.collect_set("type")).alias("types"), F.array_distinct(F.flatten(F.collect_set("kinds"))).alias("kinds"))
    now = sets.withColumnsRenamed({"types": "now", "kinds": "now_kinds"})
    was = sets.select("producer", "path", (F.col("n") + 1).alias("n"), F.col("types").alias("was"), F.col("kinds").alias("was_kinds"))
    events = touched.join(now, ["producer", "path", "n"], "left").join(was, ["producer", "path", "n"], "left")
    change = F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "removed").otherwise("type")
    events = events.withColumn("change", change)
    shut = events.where("parent = ''").select("producer", "n", F.col("path").alias("parent"))
    events = scratch.write(events.join(shut, ["producer", "n", "parent"], "left_anti"), "events")
    gone = events.where("change = 'removed'").select("producer", "n", "parent", F.col("path").alias("old"), F.col("was").alias("types"), F.col("was_kinds").alias("old_kinds"))
    come = events.where("change = 'added'").select("producer", "n", "parent", F.col("path").alias("new"), F.col("now").alias("types"), F.col("now_kinds").alias("new_kinds"))
    pairs = gone.join(come, ["producer", "n", "parent", "types"])
    table = known.names()
    stands_for = lambda c: F.element_at(table, F.element_at(F.split(c, r"\[\]\."), -1))
    a, b = stands_for(F.col("old")), stands_for(F.col("new"))
    alike = F.size(F.array_intersect("old_kinds", "new_kinds")) / F.size(F.array_union("old_kinds", "new_kinds"))
    alike = F.when(a == b, 2.0).when(a.isNull() | b.isNull(), F.when(alike >= SAME_KIND, alike))
    pairs = pairs.withColumn("alike", alike).where("alike is not null").select("producer", "n", "old", "new", "alike")
    renamed = paired(pairs, ["producer", "n"], lambda contested: shared_values(files, order, contested, known), scratch)
    rest = events.join(renamed.select("producer", "n", F.col("old").alias("path")), ["producer", "n", "path"], "left_anti")
    rest = rest.join(renamed.select("producer", "n", F.col("new").alias("path")), ["producer", "n", "path"], "left_anti")
    found = rest.select("producer", "n", F.col("path").alias("field"), "change", F.lit("").alias("new_field")).unionByName(
        renamed.select("producer", "n", F.col("old").alias("field"), F.lit("renamed").alias("change"), F.col("new").alias("new_field"))
    )
    return found.join(order, ["producer", "n"]).select("producer", "batch_id", "field", "change", "new_field").distinct()


def paired(pairs: DataFrame, keys: list[str], values: Callable[[DataFrame], DataFrame], scratch: Scratch) -> DataFrame:
    """(keys, old, new) of ``pairs`` (keys, old, new, alike), one to one: the most alike are taken until none is left.

    Where an old or a new name has several partners that are equally alike, ``values`` is asked for (keys, old, new, shared), the
    part of their values they share; what is still equal is taken in the order of names. Every round takes all pairs that
    are the best of both their sides, so competing fields are no loop of their own.
    """
    pairs = scratch.write(pairs, "pairs")
    ties = lambda side: F.count(F.lit(1)).over(Window.partitionBy(*keys, side, "alike")) > 1
    contested, n = scratch.counted(pairs.where("alike < 2").withColumn("tied", ties("old") | ties("new")).where("tied").select(*keys, "old", "new"), "contested")
    shared = values(contested) if n else contested.withColumn("shared", F.lit(0.0))
    left, n = scratch.counted(pairs.join(shared, [*keys, "old", "new"], "left").withColumn("shared", F.coalesce("shared", F.lit(0.0))), "pairs")
    best = lambda side, other: F.row_number().over(Window.partitionBy(*keys, side).orderBy(F.desc("alike"), F.desc("shared"), other))
    taken = left.select(*keys, "old", "new").limit(0)
    while n:
        now = scratch.write(left.withColumns({"i": best("old", "new"), "j": best("new", "old")}).where("i = 1 and j = 1").select(*keys, "old", "new"), "taken")
        taken = taken.unionByName(now)
        left = left.join(now.select(*keys, "old"), [*keys, "old"], "left_anti").join(now.select(*keys, "new"), [*keys, "new"], "left_anti")
        left, n = scratch.counted(left, "pairs")
    return taken


def shared_values(files: DataFrame, order: DataFrame, contested: DataFrame, known: Vocabulary) -> DataFrame:
    """(producer, n, old, new, shared) of ``contested`` fields: the part of all different values of the old field in the batch before n
    and the new one in n that both have. Only the bodies of those batches are read again."""
    sides = contested.select("producer", (F.col("n") - 1).alias("n"), F.col("old").alias("path")).unionByName(contested.select("producer", "n", F.col("new").alias("path"))).distinct()
    batches = order.join(sides.select("producer", "n").distinct(), ["producer", "n"], "left_semi")
    parts = core_parts(files.select("producer", "batch_id", "body").join(batches, ["producer", "batch_id"]), ["producer", "n"], known=known)
    top = F.array(F.struct(F.col("name").alias("path"), F.to_json("value").alias("value")))
    inside = lambda x: F.transform(F.map_entries(F.try_variant_get(x, "$", "map<string,variant>")), lambda e: F.struct(F.concat(F.col("name"), F.lit("[]."), e["key"]).alias("path"), F.to_json(e["value"]).alias("value")))
    members = F.flatten(F.filter(F.transform(F.when(F.col("family") != "caption", F.col("elements")), inside), lambda m: m.isNotNull()))
    found = parts.select("producer", "n", F.explode(F.concat(top, F.coalesce(members, F.array().cast("array<struct<path:string,value:string>>")))).alias("f"))
    found = found.select("producer", "n", "f.path", F.xxhash64("f.value").alias("v")).join(sides, ["producer", "n", "path"], "left_semi").distinct()
    sizes = found.groupBy("producer", "n", "path").agg(F.count(F.lit(1)).alias("size"))
    of = lambda df, name, back, size: df.select("producer", (F.col("n") + back).alias("n"), F.col("path").alias(name), *([F.col("size").alias(size)] if size else ["v"]))
    both = contested.join(of(found, "old", 1, None), ["producer", "n", "old"]).join(of(found, "new", 0, None), ["producer", "n", "new", "v"])
    both = both.groupBy("producer", "n", "old", "new").agg(F.count(F.lit(1)).alias("both"))
    both = both.join(of(sizes, "old", 1, "n_old"), ["producer", "n", "old"]).join(of(sizes, "new", 0, "n_new"), ["producer", "n", "new"])
    return both.select("producer", "n", "old", "new", (F.col("both") / (F.col("n_old") + F.col("n_new") - F.col("both"))).alias("shared"))


def lifespans(files: DataFrame, block: int = BLOCK) -> DataFrame:
    """(producer, path, type, from_batch, to_batch, batches): each island of the catalogue, for the log of fields."""
    files = files.where("producer is not null and batch_id is not null")
    batch = ["producer", "batch_id"]
    order = ordinals(files.groupBy(*batch).agg(F.min("written_at").alias("first_at"))).select(*batch, "n")
    seen = catalogue(files, batch).join(order, batch).select("producer", "path", "type", "n", "batch_id")
    keys = ["producer", "path", "type"]
    runs = islands(seen, keys, block=block)
    # A start's rank among starts equals its end's among ends; both are few beside the rows they come from.
    w = Window.partitionBy(*keys).orderBy("n")
    begun = runs.where("starts").select(*keys, F.col("n").alias("n1"), F.col("batch_id").alias("from_batch"), F.row_number().over(w).alias("k"))
    ended = runs.where("ends").select(*keys, F.col("n").alias("n2"), F.col("batch_id").alias("to_batch"), F.row_number().over(w).alias("k"))
    return begun.join(ended, [*keys, "k"]).select(*keys, "from_batch", "to_batch", (F.col("n2") - F.col("n1") + 1).alias("batches"))


def as_text(v: Column) -> Column:
    """Text of a field in any of its forms: plain, ``{"text": ...}``, or a list (joined by spaces)."""
    listed = F.array_join(F.try_variant_get(v, "$", "array<string>"), " ")
    return F.coalesce(F.try_variant_get(v, "$.text", "string"), F.when(kind(v) == "ARRAY", listed), F.when(kind(v) != "OBJECT", F.try_variant_get(v, "$", "string")))


def as_number(v: Column) -> Column:
    """A number in any of its forms: plain, as text, ``{"value": ...}``, or the first of a list."""
    return F.coalesce(F.try_variant_get(v, "$", "double"), F.try_variant_get(v, "$.value", "double"), F.try_variant_get(v, "$[0]", "double"))


def as_list(v: Column) -> Column:
    """A list of texts in any of its forms: a list, ``{"items": [...]}``, or one text, whose parts ``|`` separates."""
    return (
        F.when(kind(v) == "ARRAY", F.try_variant_get(v, "$", "array<string>"))
        .when(kind(v) == "OBJECT", F.try_variant_get(v, "$.items", "array<string>"))
        .when(kind(v) == "STRING", F.split(F.try_variant_get(v, "$", "string"), r"\|"))
    )


def as_numbers(v: Column) -> Column:
    """A list of numbers in any form of a list; null if a part is no number."""
    texts = F.transform(as_list(v), lambda x: F.trim(x).try_cast("double"))
    return F.when(~F.exists(texts, lambda x: x.isNull()), texts)


def as_flag(v: Column) -> Column:
    """A truth value in any of its forms: plain, as text (true, yes, 1, ...), or a number (0 is false)."""
    text = F.trim(F.try_variant_get(v, "$", "string")).try_cast("boolean")
    return F.when(kind(v).isin("BOOLEAN", "STRING"), text).otherwise(F.try_variant_get(v, "$", "double") != 0)


def as_span(v: Column) -> Column:
    """``{"start": .., "end": ..}``, plain or as JSON text."""
    v = F.coalesce(F.when(kind(v) == "STRING", F.try_parse_json(F.try_variant_get(v, "$", "string"))), v)
    start, end = (F.try_variant_get(v, f"$.{c}", "bigint") for c in ("start", "end"))
    return F.when(start.isNotNull() & end.isNotNull(), F.struct(start.alias("start"), end.alias("end")))


#: Casts by the form of a field's values.
CASTS = {"text": as_text, "number": as_number, "list": as_list, "numbers": as_numbers, "flag": as_flag, "span": as_span}


def consistent(files: DataFrame, key: str = "file_id", known: Vocabulary = KNOWN) -> DataFrame:
    """One table of all elements and acoustic captions, whatever the version of their file.

    (key, kind, pos, the vocabulary's columns, rest, text): kind is ``node``, ``entity`` (else the container's name) or
    ``acoustic_caption``. Columns and casts are generated from the alias table. rest maps the names of an element's other members to their JSON
    text: those of no column, those whose value its column can't hold, and those whose column another name fills. A repeated
    delivery of a file counts once. Elements that are no objects are left out, as are unreadable bodies; JSON null is no value.
    """
    parts = core_parts(files, [key], known=known)
    table, columns = known.names(), known.columns()
    els = parts.where("family <> 'caption'").select(key, "family", F.posexplode("elements").alias("pos", "x"))
    named = F.transform(
        F.filter(F.map_entries(F.try_variant_get("x", "$", "map<string,variant>")), lambda e: ~absent(e["value"])),
        lambda e: F.struct(F.coalesce(F.element_at(table, e["key"]), e["key"]).alias("name"), e["key"].alias("key"), e["value"].alias("value")),
    )
    els = once(els.where(kind(F.col("x")) == "OBJECT"), entries=named)
    # An element may hold both an old and a new name; the first in the order of keys stands.
    get = lambda name: F.get(F.filter("entries", lambda e: e["name"] == name), 0)
    els = once(els, **{f"__{c}": F.coalesce(*[get(name) for name in names]) for c, (_, names) in columns.items()})
    els = once(els, **{c: cast(F.col(f"__{c}.value")) for c, (cast, _) in columns.items()})
    held = F.array_compact(F.array(*[F.when(F.col(c).isNotNull(), F.col(f"__{c}.key")) for c in columns]))
    others = F.filter("entries", lambda e: ~F.array_contains("__held", e["key"]))
    rest = F.map_from_entries(F.transform(others, lambda e: F.struct(e["key"], F.to_json(e["value"]))))
    kinds = F.create_map(F.lit("nodes"), F.lit("node"), F.lit("entities"), F.lit("entity"))
    typed = once(els, __held=held).select(
        key, F.coalesce(F.element_at(kinds, F.col("family")), "family").alias("kind"), F.col("pos").cast("bigint").alias("pos"),
        *columns, rest.alias("rest"), F.lit(None).cast("string").alias("text"),
    )
    said = parts.where("family = 'caption'").select(key, F.lit("acoustic_caption").alias("kind"), F.lit(0).cast("bigint").alias("pos"), as_text(F.col("value")).alias("text"))
    return typed.unionByName(said, allowMissingColumns=True).dropDuplicates([key, "kind", "pos"])
