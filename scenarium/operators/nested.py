"""Deeply nested records to flat tables with parent links, by structural variants.

A bottom-up tree automaton (``functions.variants.state``) runs over every child element: members reach their states first,
and their states decide that of the object. Its finitely many states stand in a catalogue, made from VARIANTS alone, that
routes each relation's states to variants; each variant has a typed table of its own. Routing is a join with the catalogue.
All variants share the supertype's columns: the record, the relation, the place and the parent's place; together the
variants' tables are all children, each once. One pass over the bodies parses each of them once and emits its children
through one ``explode``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scenarium.functions.variants import absent, elements, entries, once, state, states, with_readable

#: Relation -> variants in order of test: name, what its states have (a state, or members of an object), typed columns (name, path, type).
VARIANTS: dict[str, list[tuple[str, str | dict[str, str], list[tuple[str, str, str]]]]] = {
    "node": [
        (
            "node", {"node_id": "string"},
            [("node_id", "$.node_id", "string"), ("audioset_id", "$.audioset_id", "string"), ("audioset_name", "$.audioset_name", "string"),
             ("node_type", "$.node_type", "string"), ("evidence", "$.evidence", "string"), ("confidence", "$.confidence", "double"),
             ("parent_ids", "$.parent_ids", "array<string>"), ("top_level_ids", "$.top_level_ids", "array<string>")],
        ),
        ("anonymous_node", {}, [("audioset_id", "$.audioset_id", "string"), ("audioset_name", "$.audioset_name", "string"), ("evidence", "$.evidence", "string")]),
    ],
    "visual_term": [("term", "string", [("term", "$", "string")])],
    "node_term": [("evidence_term", "string", [("term", "$", "string")])],
    "grounding": [
        (
            "box", {"bbox": "numbers"},
            [("node_id", "$.node_id", "string"), ("visual_label_raw", "$.visual_label_raw", "string"), ("bbox", "$.bbox", "array<double>"),
             ("source", "$.source", "string"), ("detector_confidence", "$.detector_confidence", "double")],
        ),
        ("boxless", {}, [("node_id", "$.node_id", "string"), ("visual_label_raw", "$.visual_label_raw", "string"), ("source", "$.source", "string")]),
    ],
    "category_count": [("count", "number", [("count", "$", "double")]), ("no_count", "null", [])],
}
#: Transitions of the automaton: members whose states tell variants apart.
MEMBERS = sorted({pair for rules in VARIANTS.values() for _, want, _ in rules if isinstance(want, dict) for pair in want.items()})
#: The variant of whatever no rule takes: kept as JSON text.
IRREGULAR = "irregular"


def children(records: DataFrame, key: str, body: str) -> DataFrame:
    """(key, rel, pos, parent, value): one row per non-null child element of each readable body.

    Null elements give no row but keep their place; blank strings give rows; a category count gives a row whatever its
    value. Unreadable bodies give none. A record delivered again gives its rows again (see ``supertype``).
    """
    v = F.col("__v")
    child = "struct<rel:string,pos:string,parent:string,value:variant>"
    nodes, terms = elements(v, "$.core.nodes"), elements(v, "$.core.visual_terms")
    boxes, counts = elements(v, "$.extended.grounding"), entries(v, "$.extended.global_geometry.category_counts")

    def row(rel: str, pos: Column, parent: Column, value: Column) -> Column:
        return F.struct(F.lit(rel).alias("rel"), pos.cast("string").alias("pos"), parent.cast("string").alias("parent"), value.alias("value"))

    none = F.lit("")
    here = with_readable(records.select(key, F.col(body).alias("__body")), "__body", "__v")
    here = once(here, nodes=nodes, terms=terms, boxes=boxes, counts=counts).drop("__v", "__body")
    ids = F.transform("nodes", lambda x: F.try_variant_get(x, "$.node_id", "string"))
    own = F.transform("nodes", lambda x, i: row("node", i, none, x))
    evidence = F.flatten(
        F.transform("nodes", lambda x, i: F.transform(elements(x, "$.visual_evidence_terms"), lambda t, j: row("node_term", F.concat_ws(".", i.cast("string"), j.cast("string")), i, t)))
    )
    said = F.transform("terms", lambda x, i: row("visual_term", i, none, x))

    def owner(x: Column) -> Column:
        at = F.array_position(F.col("ids"), F.try_variant_get(x, "$.node_id", "string"))
        return F.when(at > 0, (at - 1).cast("string"))

    seen = F.transform("boxes", lambda x, i: row("grounding", i, F.coalesce(owner(x), none), x))
    counted = F.transform("counts", lambda e: row("category_count", e["key"], none, e["value"]))
    lists = once(here, ids=ids).select(
        key, F.concat(*[F.filter(part, lambda r: ~absent(r["value"])).cast(f"array<{child}>") for part in (own, evidence, said, seen)], counted.cast(f"array<{child}>")).alias("all")
    )
    return lists.select(key, F.explode("all").alias("child")).select(key, "child.*")


def catalogue() -> list[tuple[str, str, str]]:
    """(rel, state, variant) of every relation and state: the first of VARIANTS that takes the state, else ``irregular``."""

    def takes(want: str | dict[str, str], at: str) -> bool:
        if isinstance(want, str):
            return at == want
        held = at.removeprefix("object(").removesuffix(")").split(",")
        return at.startswith("object(") and all(f"{key}:{kind}" in held for key, kind in want.items())

    return [(rel, at, next((name for name, want, _ in rules if takes(want, at)), IRREGULAR)) for rel, rules in VARIANTS.items() for at in states(MEMBERS)]


def classified(rows: DataFrame) -> DataFrame:
    """Children with ``state`` and ``variant``, routed by a join with the catalogue (some sixty fixed rows, broadcast)."""
    routes = rows.sparkSession.createDataFrame(catalogue(), "rel string, state string, variant string")
    return rows.withColumn("state", state(F.col("value"), MEMBERS)).join(F.broadcast(routes), ["rel", "state"])


def supertype(rows: DataFrame, key: str) -> DataFrame:
    """(key, rel, pos, parent) of classified children: the columns that all variants' tables share, united; each child once."""
    return rows.where("variant is not null").select(key, "rel", "pos", "parent").distinct()


def subtype(rows: DataFrame, key: str, rel: str, variant: str) -> DataFrame:
    """The typed table of one variant. ``rows``: classified children. Irregular ones have their JSON text."""
    columns = [("json", "$", "string")] if variant == IRREGULAR else next(c for name, _, c in VARIANTS[rel] if name == variant)
    here = rows.where((F.col("rel") == rel) & (F.col("variant") == variant))
    if variant == IRREGULAR:
        return here.select(key, "pos", "parent", F.to_json("value").alias("json")).distinct()
    return here.select(key, "pos", "parent", *[F.try_variant_get("value", path, kind).alias(name) for name, path, kind in columns]).distinct()
