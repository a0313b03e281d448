"""Queries that keep stored predictions in order: drifting schemas, hierarchies, nested bodies, orphans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scenarium.operators import drift, hierarchy, nested, orphans
from scenarium.plans.tables import table
from scenarium.storage import Scratch, together


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return drift.changes(table(spark, folder, "pred_files"))


def p1_elements(spark: SparkSession, folder: str) -> DataFrame:
    return drift.consistent(table(spark, folder, "pred_files"))


def p1_lifespans(spark: SparkSession, folder: str) -> DataFrame:
    return drift.lifespans(table(spark, folder, "pred_files"))


def _ontology(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    raw = table(spark, folder, "onto_nodes").select("ontology_id", "id", "child_ids")
    return raw, *hierarchy.edges_of(raw)


def contradicted(core: DataFrame, stored: str, truth: DataFrame) -> DataFrame:
    """Rows of ``core`` (pred_id, node_id, audioset_id, a list ``stored``) whose list, as a set, isn't that of ``truth``
    (audioset_id, value). Null lists are not recorded and no case; a null element is in no true set.

    Each distinct pair of id and list is checked once, by counting: no set is gathered in one place.
    """
    text = F.array_join(F.array_sort(F.array_distinct(stored)), "\u0001", "\u0000")
    rows = core.where(F.col(stored).isNotNull()).select("pred_id", "node_id", "audioset_id", F.array_distinct(stored).alias("stored"), text.alias("sig"))
    pairs = rows.groupBy("audioset_id", "sig").agg(F.first("stored").alias("stored"))
    sizes = truth.groupBy("audioset_id").agg(F.count(F.lit(1)).alias("n_true"))
    told = pairs.select("audioset_id", "sig", F.explode_outer("stored").alias("value"))
    hit = told.join(truth.withColumn("hit", F.lit(1)), ["audioset_id", "value"], "left").groupBy("audioset_id", "sig").agg(F.count("hit").alias("n_hit"))
    judged = pairs.join(hit, ["audioset_id", "sig"], "left").join(sizes, "audioset_id", "left")
    n = lambda c: F.coalesce(c, F.lit(0))
    bad = judged.where((n(F.col("n_true")) != F.size("stored")) | (n(F.col("n_hit")) != F.size("stored"))).select("audioset_id", "sig")
    known = rows.where("audioset_id is not null").join(bad, ["audioset_id", "sig"], "left_semi")
    # Without an id there are no true parents: any stored element contradicts.
    unknown = rows.where("audioset_id is null and size(stored) > 0")
    return known.select("pred_id", "node_id").unionByName(unknown.select("pred_id", "node_id")).distinct()


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    raw, nodes, edges = _ontology(spark, folder)
    scratch = Scratch(spark, "p3")
    edges = scratch.write(edges, "edges")
    done = hierarchy.contract(nodes, edges, "roots")
    cyclic, tops = hierarchy.cycle_nodes(done), hierarchy.roots_above(done)  # one after the other: the driver plans one job at a time
    owners = raw.where("id is not null").select("ontology_id", F.col("id").alias("node")).distinct()
    cycles = owners.join(cyclic, "node", "left_semi").select(F.lit("cycle").alias("kind"), F.col("ontology_id").alias("owner"), "node")
    core = table(spark, folder, "core_nodes").select("pred_id", "node_id", "audioset_id", "parent_ids", "top_level_ids")
    parents = edges.select(F.col("c").alias("audioset_id"), F.col("p").alias("value"))
    tops = tops.select(F.col("node").alias("audioset_id"), F.col("root").alias("value"))
    cases = lambda kind, df: df.select(F.lit(kind).alias("kind"), F.col("pred_id").cast("string").alias("owner"), F.col("node_id").alias("node"))
    found = cycles.unionByName(cases("parents", contradicted(core, "parent_ids", parents))).unionByName(cases("top_levels", contradicted(core, "top_level_ids", tops)))
    return found


def p3_nodes(spark: SparkSession, folder: str) -> DataFrame:
    """Each node: depth (longest way from a root that touches no cycle, else null) and number of such ways, number of roots, the
    nearest one's distance and the first one by id, descendants (without itself) and whether it is on a cycle."""
    _, nodes, edges = _ontology(spark, folder)
    scratch = Scratch(spark, "p3")
    nodes, edges = scratch.write(nodes, "nodes"), scratch.write(edges, "edges")
    done = hierarchy.contract(nodes, edges, "ancestors")
    cyclic, roots, below = together(spark, lambda: hierarchy.cycle_nodes(done), lambda: hierarchy.roots_above(done), lambda: hierarchy.ancestors(done))
    roots = roots.groupBy("node").agg(F.count(F.lit(1)).alias("n_roots"), F.min("near").alias("near"), F.min("root").alias("first_root"))
    below = below.where("anc <> node").groupBy(F.col("anc").alias("node")).agg(F.count(F.lit(1)).alias("n_descendants"))
    ways = hierarchy.measures(nodes, edges, cyclic)
    all_ = nodes.join(roots, "node", "left").join(below, "node", "left").join(ways.withColumn("__way", F.lit(True)), "node", "left").join(cyclic.withColumn("on_cycle", F.lit(True)), "node", "left")
    zero = {c: F.coalesce(c, F.lit(0).cast("bigint")) for c in ("n_roots", "n_descendants")} | {"n_paths": F.when(F.col("__way").isNull(), F.lit(0).cast("bigint")).otherwise(F.col("n_paths"))}
    return all_.withColumns(zero | {"on_cycle": F.coalesce("on_cycle", F.lit(False))}).drop("__way")


def p3_paths(spark: SparkSession, folder: str) -> DataFrame:
    _, nodes, edges = _ontology(spark, folder)
    cyclic = hierarchy.cycle_nodes(hierarchy.contract(nodes, edges, "roots"))
    return hierarchy.root_paths(nodes, edges, cyclic).select("node", F.array_join("path", " > ").alias("path"), "depth")


def p3_descendants(spark: SparkSession, folder: str) -> DataFrame:
    _, nodes, edges = _ontology(spark, folder)
    return hierarchy.ancestors(hierarchy.contract(nodes, edges, "ancestors")).where("anc <> node").select("anc", F.col("node").alias("descendant"))


def _children(spark: SparkSession, folder: str) -> DataFrame:
    return nested.children(table(spark, folder, "nested_preds"), "nested_id", "body")


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return nested.supertype(nested.classified(_children(spark, folder)), "nested_id")


def p4_nodes(spark: SparkSession, folder: str) -> DataFrame:
    return nested.subtype(nested.classified(_children(spark, folder)), "nested_id", "node", "node")


def p4_groundings(spark: SparkSession, folder: str) -> DataFrame:
    return nested.subtype(nested.classified(_children(spark, folder)), "nested_id", "grounding", "box")


def p4_node_terms(spark: SparkSession, folder: str) -> DataFrame:
    return nested.subtype(nested.classified(_children(spark, folder)), "nested_id", "node_term", "evidence_term")


def p4_visual_terms(spark: SparkSession, folder: str) -> DataFrame:
    return nested.subtype(nested.classified(_children(spark, folder)), "nested_id", "visual_term", "term")


def p4_category_counts(spark: SparkSession, folder: str) -> DataFrame:
    return nested.subtype(nested.classified(_children(spark, folder)), "nested_id", "category_count", "count")


def p4_irregular(spark: SparkSession, folder: str) -> DataFrame:
    """Children no typed variant takes, as JSON, over all relations."""
    rows = nested.classified(_children(spark, folder)).where(F.col("variant").isin(nested.IRREGULAR, "anonymous_node", "boxless", "no_count"))
    return rows.select("nested_id", "rel", "pos", "parent", "variant", F.to_json("value").alias("json")).distinct()


def p4_variants(spark: SparkSession, folder: str) -> DataFrame:
    """The catalogue of shapes: how many children of each relation reach which state and variant."""
    rows = nested.classified(_children(spark, folder)).select("nested_id", "rel", "pos", "parent", "variant", "state").distinct()
    return rows.groupBy("rel", "variant", "state").agg(F.count(F.lit(1)).alias("n"))


def _orphans(spark: SparkSession, folder: str) -> DataFrame:
    def part(tbl: str, fields: list[str], target: str, key: str) -> DataFrame:
        parents = table(spark, folder, target).select(F.col("pred_id").alias("scope"), F.col(key).alias("key"), F.col("ingested_at").alias("arrived"), F.col("deleted_at").alias("deleted"))
        rows = table(spark, folder, tbl).select(
            "row_id", F.col("pred_id").alias("scope"), F.col("ingested_at").alias("arrived"),
            F.explode(F.array(*[F.struct(F.lit(i).cast("tinyint").alias("place"), F.col(f).alias("key")) for i, f in enumerate(fields)])).alias("r"),
        ).select("row_id", "scope", "arrived", "r.place", "r.key")
        name = F.element_at(F.array(*[F.lit(f) for f in fields]), F.col("place") + 1)
        return orphans.find_orphans(rows, parents, keys=["row_id", "place"]).select(F.lit(tbl).alias("tbl"), "row_id", name.alias("field"), "arrived", "status")

    found = together(spark, lambda: part("groundings", ["node_id"], "core_nodes", "node_id"), lambda: part("interactions", ["subject_id", "object_id"], "entities", "id"))
    return found[0].unionByName(found[1])


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return _orphans(spark, folder).select("tbl", "row_id", "field", "status")


def p5_report(spark: SparkSession, folder: str) -> DataFrame:
    return orphans.orphan_report(_orphans(spark, folder), F.date_format("arrived", "yyyy-MM"))


QUERIES = {
    f.__name__: f
    for f in (
        p1_found, p1_elements, p1_lifespans, p3_found, p3_nodes, p3_paths, p3_descendants, p4_found, p4_nodes, p4_groundings, p4_node_terms,
        p4_visual_terms, p4_category_counts, p4_irregular, p4_variants, p5_found, p5_report,
    )
}

_EDGES = """
ids as (select distinct id from onto_nodes where id is not null),
edges as (select distinct n.id as p, u.c as c from onto_nodes n, unnest(n.child_ids) as u(c) where n.id is not null and u.c in (select id from ids)),
roots as (select id from ids where id not in (select c from edges)),
"""
_REACH = """
reach(a, b) as (select p, c from edges union select r.a, e.c from reach r join edges e on r.b = e.p),
"""
_STATUS = """
select distinct tbl, row_id, field, case when t_from is null then 'missing' when t_from > arrived then 'late' else 'deleted' end as status
from (
  select r.*, t.t_from, t.t_until from refs r left join targets t on t.kind = r.tbl and t.pred_id = r.pred_id and t.k = r.k
) where t_from is null or t_from > arrived or t_until <= arrived
"""
_REFS = """
with g as (select row_id, min(ingested_at) as arrived, any_value(pred_id) as pred_id, any_value(node_id) as node_id from groundings group by row_id),
i as (select row_id, min(ingested_at) as arrived, any_value(pred_id) as pred_id, any_value(subject_id) as s, any_value(object_id) as o from interactions group by row_id),
refs as (
  select tbl, row_id, field, arrived, pred_id, lower(trim(k)) as k from (
    select 'groundings' as tbl, row_id, 'node_id' as field, arrived, pred_id, node_id as k from g
    union all select 'interactions', row_id, 'subject_id', arrived, pred_id, s from i
    union all select 'interactions', row_id, 'object_id', arrived, pred_id, o from i
  ) where k is not null and trim(k) <> ''
),
targets as (
  select kind, pred_id, k, min(a) as t_from, max(d) as t_until from (
    select 'groundings' as kind, pred_id, lower(trim(node_id)) as k, ingested_at as a, coalesce(deleted_at, timestamp '9999-12-31') as d from core_nodes
    union all select 'interactions', pred_id, lower(trim(id)), ingested_at, coalesce(deleted_at, timestamp '9999-12-31') from entities
  ) group by kind, pred_id, k
)
"""
_BODIES = r"""
with cleaned as (select nested_id, ltrim(body, chr(65279) || ' ' || chr(10)) as b from nested_preds),
opened as (select nested_id, case when b[1] = '"' and json_valid(b) then b::json->>'$' else b end as b from cleaned),
bodies as (select distinct nested_id, case when json_valid(b) then case when json_type(b) = 'OBJECT' then b::json end end as j from opened),
nodes as (select nested_id, e.key::bigint as pos, e.value as v from bodies, json_each(j, '$.core.nodes') e where json_type(j, '$.core.nodes') = 'ARRAY'),
"""

_NUMBERS = """json_type(v, '$.bbox') = 'ARRAY' and len(list_filter(json_extract(v, '$.bbox[*]'), lambda x: json_type(x) <> 'NULL')) > 0
  and len(list_filter(json_extract(v, '$.bbox[*]'), lambda x: json_type(x) not in ('NULL', 'BIGINT', 'UBIGINT', 'DOUBLE', 'HUGEINT'))) = 0"""
_BOXES = """
owner as (select nested_id, v->>'$.node_id' as node_id, min(pos) as pos from nodes where json_type(v) <> 'NULL' group by all),
boxes as (
  select b.nested_id, b.key as pos, coalesce(o.pos::varchar, '') as parent, b.v from (
    select nested_id, e.key::varchar as key, e.value as v from bodies, json_each(j, '$.extended.grounding') e where json_type(j, '$.extended.grounding') = 'ARRAY' and json_type(e.value) <> 'NULL'
  ) b left join owner o on o.nested_id = b.nested_id and o.node_id = b.v->>'$.node_id'
)
"""

SQL = {
    "p3_found": "with recursive" + _EDGES + _REACH + """
tops as (select b as id, a as root from reach where a in (select id from roots) union select id, id from roots),
t as (select id, list_sort(list(distinct root)) as l from tops group by id),
q as (select c as id, list_sort(list(distinct p)) as l from edges group by c)
select distinct 'cycle' as kind, ontology_id as owner, id as node from onto_nodes where id in (select a from reach where a = b)
union select 'parents', pred_id::varchar, node_id from core_nodes n left join q on q.id = n.audioset_id
where parent_ids is not null and list_sort(list_distinct(parent_ids)) <> coalesce(q.l, [])
union select 'top_levels', pred_id::varchar, node_id from core_nodes n left join t on t.id = n.audioset_id
where top_level_ids is not null and list_sort(list_distinct(top_level_ids)) <> coalesce(t.l, [])
""",
    "p3_descendants": "with recursive" + _EDGES + _REACH + "done as (select 1) select a as anc, b as descendant from reach where a <> b",
    "p3_paths": "with recursive" + _EDGES + _REACH + """
cyc as (select a as id from reach where a = b),
ways(node, path, depth) as (
  select id, id, 0::bigint from roots where id not in (select id from cyc)
  union all select e.c, w.path || ' > ' || e.c, w.depth + 1 from ways w join edges e on e.p = w.node where e.c not in (select id from cyc)
)
select node, path, depth from ways
""",
    "p4_found": _BODIES + """
owner as (select nested_id, v->>'$.node_id' as node_id, min(pos) as pos from nodes where json_type(v) <> 'NULL' group by all)
select nested_id, 'node' as rel, pos::varchar as pos, '' as parent from nodes where json_type(v) <> 'NULL'
union select nested_id, 'node_term', n.pos || '.' || e.key, n.pos::varchar from nodes n, json_each(n.v, '$.visual_evidence_terms') e
  where json_type(n.v, '$.visual_evidence_terms') = 'ARRAY' and json_type(e.value) <> 'NULL'
union select nested_id, 'visual_term', e.key::varchar, '' from bodies, json_each(j, '$.core.visual_terms') e
  where json_type(j, '$.core.visual_terms') = 'ARRAY' and json_type(e.value) <> 'NULL'
union select b.nested_id, 'grounding', b.key, coalesce(o.pos::varchar, '') from (
  select nested_id, e.key::varchar as key, e.value->>'$.node_id' as node_id from bodies, json_each(j, '$.extended.grounding') e
  where json_type(j, '$.extended.grounding') = 'ARRAY' and json_type(e.value) <> 'NULL') b left join owner o on o.nested_id = b.nested_id and o.node_id = b.node_id
union select nested_id, 'category_count', e.key::varchar, '' from bodies, json_each(j, '$.extended.global_geometry.category_counts') e
  where json_type(j, '$.extended.global_geometry.category_counts') = 'OBJECT'
""",
    "p3_nodes": "with recursive" + _EDGES + _REACH + """
cyc as (select distinct a as id from reach where a = b),
ways(node, path, depth) as (
  select id, id, 0::bigint from roots where id not in (select id from cyc)
  union all select e.c, w.path || ' > ' || e.c, w.depth + 1 from ways w join edges e on e.p = w.node where e.c not in (select id from cyc)
),
far(node, root, d) as (select id, id, 0::bigint from roots union select e.c, f.root, f.d + 1 from far f join edges e on e.p = f.node where f.d < 60),
t as (select node, count(distinct root) as n_roots, min(d) as near, min(root) as first_root from far group by node),
w as (select node, max(depth) as depth, count(*) as n_paths from ways group by node), d as (select a as node, count(*) as n from (select distinct a, b from reach where a <> b) group by a)
select ids.id as node, coalesce(n_roots, 0) as n_roots, near, first_root, coalesce(d.n, 0) as n_descendants, depth, coalesce(n_paths, 0) as n_paths, ids.id in (select id from cyc) as on_cycle
from ids left join t on t.node = ids.id left join w on w.node = ids.id left join d on d.node = ids.id
""",
    "p4_nodes": _BODIES + """
done as (select 1)
select distinct nested_id, pos::varchar as pos, '' as parent, v->>'$.node_id' as node_id, v->>'$.audioset_id' as audioset_id, v->>'$.audioset_name' as audioset_name, v->>'$.node_type' as node_type, v->>'$.evidence' as evidence,
  try_cast(v->>'$.confidence' as double) as confidence, case when json_type(v, '$.parent_ids') = 'ARRAY' then list_transform(json_extract(v, '$.parent_ids[*]'), lambda x: x->>'$') end as parent_ids,
  case when json_type(v, '$.top_level_ids') = 'ARRAY' then list_transform(json_extract(v, '$.top_level_ids[*]'), lambda x: x->>'$') end as top_level_ids
from nodes where json_type(v) = 'OBJECT' and json_type(v, '$.node_id') = 'VARCHAR'
""",
    "p4_node_terms": _BODIES + """
done as (select 1)
select distinct nested_id, n.pos || '.' || e.key as pos, n.pos::varchar as parent, e.value->>'$' as term from nodes n, json_each(n.v, '$.visual_evidence_terms') e
where json_type(n.v, '$.visual_evidence_terms') = 'ARRAY' and json_type(e.value) = 'VARCHAR'
""",
    "p4_groundings": _BODIES + _BOXES + """
select distinct nested_id, pos, parent, v->>'$.node_id' as node_id, v->>'$.visual_label_raw' as visual_label_raw, list_transform(json_extract(v, '$.bbox[*]'), lambda x: (x->>'$')::double) as bbox, v->>'$.source' as source,
  try_cast(v->>'$.detector_confidence' as double) as detector_confidence from boxes where """ + _NUMBERS + """
""",
    "p4_variants": _BODIES + _BOXES.rstrip() + """,
k as (
  select nested_id, 'node' as rel, pos::varchar as pos, '' as parent, v from nodes where json_type(v) <> 'NULL'
  union all select nested_id, 'node_term', n.pos || '.' || e.key, n.pos::varchar, e.value from nodes n, json_each(n.v, '$.visual_evidence_terms') e where json_type(n.v, '$.visual_evidence_terms') = 'ARRAY' and json_type(e.value) <> 'NULL'
  union all select nested_id, 'visual_term', e.key::varchar, '', e.value from bodies, json_each(j, '$.core.visual_terms') e where json_type(j, '$.core.visual_terms') = 'ARRAY' and json_type(e.value) <> 'NULL'
  union all select nested_id, 'grounding', pos, parent, v from boxes
  union all select nested_id, 'category_count', e.key::varchar, '', e.value from bodies, json_each(j, '$.extended.global_geometry.category_counts') e where json_type(j, '$.extended.global_geometry.category_counts') = 'OBJECT'
),
s as (
  select distinct nested_id, rel, pos, parent, case json_type(v) when 'VARCHAR' then 'string' when 'NULL' then 'null' when 'BOOLEAN' then 'boolean' when 'ARRAY' then 'array' when 'OBJECT' then
    'object(' || array_to_string(list_filter([case when """ + _NUMBERS + """ then 'bbox:numbers' end, case when json_type(v, '$.node_id') = 'VARCHAR' then 'node_id:string' end], lambda x: x is not null), ',') || ')' else 'number' end as state from k
)
select rel, state, count(*) as n, case when rel = 'node' and state like 'object(%node_id:string%' then 'node' when rel = 'node' and state like 'object%' then 'anonymous_node' when rel = 'visual_term' and state = 'string' then 'term'
  when rel = 'node_term' and state = 'string' then 'evidence_term' when rel = 'grounding' and state like 'object(bbox:numbers%' then 'box' when rel = 'grounding' and state like 'object%' then 'boxless'
  when rel = 'category_count' and state = 'number' then 'count' when rel = 'category_count' and state = 'null' then 'no_count' else 'irregular' end as variant
from s group by rel, state
""",
    "p4_visual_terms": _BODIES + """
done as (select 1)
select distinct nested_id, e.key::varchar as pos, '' as parent, e.value->>'$' as term from bodies, json_each(j, '$.core.visual_terms') e
where json_type(j, '$.core.visual_terms') = 'ARRAY' and json_type(e.value) = 'VARCHAR'
""",
    "p4_category_counts": _BODIES + """
done as (select 1)
select distinct nested_id, e.key::varchar as pos, '' as parent, e.value::double as count from bodies, json_each(j, '$.extended.global_geometry.category_counts') e
where json_type(j, '$.extended.global_geometry.category_counts') = 'OBJECT' and json_type(e.value) <> 'NULL'
""",
    "p5_found": _REFS + _STATUS,
    "p5_report": _REFS + "select tbl, field, strftime(arrived, '%Y-%m') as period, status, count(*) as n from (" + _STATUS.replace("select distinct tbl", "select tbl, arrived", 1) + ") group by all",
}
