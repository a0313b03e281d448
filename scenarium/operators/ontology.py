"""Measures on an ontology with several parents per node, on top of its contracted hierarchy."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scenarium.operators import hierarchy


def nodes_table(raw: DataFrame) -> DataFrame:
    """(id, name, usable): one row per node of ``raw`` (id, name, restrictions, ...); usable unless blacklisted or abstract.

    A node in several rows has the least of its names and all its restrictions.
    """
    marks = F.array_distinct(F.flatten(F.collect_list(F.coalesce("restrictions", F.array().cast("array<string>")))))
    return raw.where("id is not null").groupBy("id").agg(F.min("name").alias("name"), marks.alias("m")).select("id", "name", (~F.arrays_overlap("m", F.array(F.lit("blacklist"), F.lit("abstract")))).alias("usable"))


def leaves(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Ids of usable nodes without children."""
    return nodes.where("usable").select("id").join(edges.select(F.col("p").alias("id")).distinct(), "id", "left_anti")


def dangling(raw: DataFrame) -> DataFrame:
    """(id, child): references to children that no row defines."""
    listed = raw.where("id is not null").select("id", F.explode("child_ids").alias("child")).where("child is not null").distinct()
    return listed.join(raw.select(F.col("id").alias("child")).distinct(), "child", "left_anti").select("id", "child")


def names_to_ids(nodes: DataFrame) -> DataFrame:
    """(name, id): full names in lower case, then their comma-separated parts where no full name is the same; least id on ties.

    Only usable nodes are found.
    """
    good = nodes.where("usable and name is not null")
    full = good.select(F.lower(F.trim("name")).alias("name"), "id", F.lit(0).alias("rank"))
    part = good.select(F.explode(F.split("name", ",")).alias("name"), "id").select(F.lower(F.trim("name")).alias("name"), "id", F.lit(1).alias("rank"))
    return full.unionByName(part).where("name <> ''").groupBy("name").agg(F.min(F.struct("rank", "id"))["id"].alias("id"))


def parents_or_self(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, parent): a node's parents, or itself if it has none."""
    return nodes.select(F.col("id").alias("node")).join(edges.select(F.col("c").alias("node"), F.col("p").alias("parent")), "node", "left").withColumn("parent", F.coalesce("parent", "node"))


def integrity(raw: DataFrame) -> DataFrame:
    """One row: nodes, roots, nodes with several parents, dangling references, nodes on cycles."""
    nodes, edges = hierarchy.edges_of(raw)
    cyc = hierarchy.cycle_nodes(hierarchy.contract(nodes, edges))
    into = edges.groupBy("c").agg(F.count(F.lit(1)).alias("n"))
    one = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    parts = [
        one(nodes, "n_nodes"), one(nodes.join(into.select(F.col("c").alias("node")), "node", "left_anti"), "n_roots"), one(into.where("n > 1"), "n_multi_parent"),
        one(dangling(raw), "n_dangling"), one(cyc, "n_cyclic"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.join(p)  # single rows
    return out


def similarities(pairs: DataFrame, reach: DataFrame, depths: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """(a, b, lca_id, lca, distance, near) of ``pairs`` (a, b).

    ``reach``: (node, anc, near); ``depths``: (node, depth), the longest way from a root, 0 for nodes without a row; ``names``: (id, name).
    lca: twice the depth of the deepest common ancestor over the sum of both depths (1 for two of depth 0 that share one), 0
    without one. distance: least steps over a common ancestor, null without one. near: 1 / (1 + distance), or 0. lca_id: the
    deepest, then the greatest name, then the greatest id.
    """
    pairs = pairs.select("a", "b").distinct()
    up = lambda x: reach.select(F.col("node").alias(x), "anc", F.col("near").alias(f"n_{x}"))
    d = lambda x, y: depths.select(F.col("node").alias(x), F.col("depth").alias(y))
    shared = pairs.join(up("a"), "a").join(up("b"), ["b", "anc"]).join(d("anc", "d"), "anc", "left")
    title = F.lit("")
    if names is not None:
        shared, title = shared.join(names.select(F.col("id").alias("anc"), "name"), "anc", "left"), F.coalesce("name", F.lit(""))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("bigint"))
    best = shared.groupBy("a", "b").agg(F.max(zero("d")).alias("d"), F.min(F.col("n_a") + F.col("n_b")).alias("distance"), F.max(F.struct(zero("d"), title, "anc"))["anc"].alias("lca_id"))
    best = best.join(d("a", "d_a"), "a", "left").join(d("b", "d_b"), "b", "left")
    sum_ = zero("d_a") + zero("d_b")
    score = F.when(sum_ == 0, 1.0).otherwise(2.0 * F.col("d") / sum_)
    return pairs.join(best.select("a", "b", "lca_id", score.alias("lca"), "distance"), ["a", "b"], "left").select(
        "a", "b", "lca_id", F.coalesce("lca", F.lit(0.0)).alias("lca"), "distance", F.coalesce(1.0 / (1.0 + F.col("distance")), F.lit(0.0)).alias("near")
    )


def path_names(paths: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, path): each root path in names, joined by `` > ``. ``paths``: (node, path of ids)."""
    steps = paths.select("node", F.array_join("path", "\u0001").alias("way"), F.posexplode("path").alias("i", "id"))
    named = steps.join(nodes.select("id", "name"), "id").groupBy("node", "way").agg(F.array_sort(F.collect_list(F.struct("i", "name"))).alias("s"))
    return named.select("node", F.array_join(F.transform("s", lambda x: x["name"]), " > ").alias("path"))
