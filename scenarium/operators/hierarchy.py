"""Parent-child links to full hierarchies, by tree contraction.

``contract`` alternates two steps on the edge table until nothing is left to do. *Raking* removes every node without
children. *Compression* removes nodes of unary chains (one parent, one child), an independent set of them at a time: those
whose hash is smaller than their neighbours', so that a chain of length n is gone after O(log n) rounds. Each removal
is recorded with the parents it then had. A node has one hash for all rounds, so that all rounds run the same compiled code. Reversing the records, last round first, gives every node what its parents
know: roots and depths, full paths, or all ancestors (whose mirror image are the descendants).

A node may have several parents. What can neither be raked nor compressed is the core: its nodes lie on cycles or lead
to one, and it is solved by itself (components by colouring, reachability by frontier). Graphs whose spines have a second
parent at every node lose one level a round; what is left of them after MAX_ROUNDS goes the core's way, too. There
is no other way for small graphs: a graph of any size is contracted.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scenarium.storage import Scratch

#: Rounds that contraction may take before the rest goes to the core's solver: chains of 2**40 nodes end before.
MAX_ROUNDS = 100
#: Tables of known facts that are read together before they are written as one.
PARTS = 8
#: What an edge carries beside its ends: the nodes removed on it (roots), in order (paths), or each with its distance from the lower end. A node
#: is on one edge at most, so that all edges carry no more than all nodes.
_VIA = {"roots": "array<string>", "measures": "array<string>", "paths": "array<string>", "ancestors": "array<struct<anc:string,near:bigint>>"}


@dataclass
class Contraction:
    """Recorded removals by round, and the edges that are left."""

    scratch: Scratch
    nodes: DataFrame
    sources: DataFrame
    records: list[DataFrame] = field(default_factory=list)
    rest: DataFrame | None = None
    rest_edges: int = 0


def edges_of(nodes: DataFrame, node: str = "id", children: str = "child_ids") -> tuple[DataFrame, DataFrame]:
    """Nodes (``node``) and edges (``p``, ``c``) of a table with lists of children.

    Rows of one node add up; repeated, null and dangling child ids are dropped, null ids too. The set operations
    aggregate before they shuffle, so a node repeated in a third of all rows is no hot spot.
    """
    ids = nodes.where(F.col(node).isNotNull()).select(F.col(node).alias("node")).distinct()
    listed = nodes.where(F.col(node).isNotNull()).select(F.col(node).alias("p"), F.explode(children).alias("c")).where("c is not null").distinct()
    return ids, listed.join(ids, listed.c == ids.node, "left_semi")


def contract(nodes: DataFrame, edges: DataFrame, keep: str = "roots", max_rounds: int = MAX_ROUNDS) -> Contraction:
    """Contract ``edges`` (p, c).

    ``keep`` says what can be recovered. ``roots``: parallel ways between two nodes become one, of the least length, that carries the nodes removed on them.
    ``measures``: one of the least and the greatest length and the number of ways (null: beyond BIGINT). ``ancestors``: one that carries
    the set of the nodes removed on them with their distances. ``paths``: they stay apart, each with its nodes in order.
    """
    scratch = Scratch(nodes.sparkSession, "hierarchy")
    nodes = scratch.write(nodes.select("node"), "nodes")
    none, one = F.array().cast(_VIA[keep]), F.lit(1).cast("bigint")
    now = scratch.write(edges.select("p", "c", one.alias("len"), one.alias("far"), one.alias("ways"), none.alias("via")), "edges")
    sources = scratch.write(nodes.join(now.select(F.col("c").alias("node")).distinct(), "node", "left_anti"), "sources")
    done = Contraction(scratch, nodes, sources)
    carried = ["len", "far", "ways", "via"]
    to_go = F.col("in_ok") & (F.col("c_o") > 0)
    marked, size, chains = scratch.observed(_marked(now, carried), "marked", F.count(F.lit(1)), F.count_if(to_go))
    while size and len(done.records) < max_rounds:
        raked = marked.where("c_o = 0").select(F.col("c").alias("node"), F.col("p").alias("parent"), *carried, F.lit(None).cast("string").alias("tail"))
        record, after = raked, marked.where("c_o > 0").select("p", "c", *carried)
        if chains:
            first = marked.where(to_go).select("p", F.col("c").alias("x"), *[F.col(k).alias(f"{k}1") for k in carried])
            second = marked.where("out_ok").select(F.col("p").alias("x"), "c", *[F.col(k).alias(f"{k}2") for k in carried])
            gone = scratch.write(first.join(second, "x"), "chains")
            record = raked.unionByName(gone.select(F.col("x").alias("node"), F.col("p").alias("parent"), *[F.col(f"{k}1").alias(k) for k in carried], F.col("c").alias("tail")))
            left = after.join(gone.select(F.col("x").alias("c")), "c", "left_anti").join(gone.select(F.col("x").alias("p")), "p", "left_anti")
            after = left.select("p", "c", *carried).unionByName(gone.select("p", "c", *_united(keep)))
            if keep == "paths":
                after = after.repartition("p")  # shuffled once for the three uses that marking makes of it
            else:  # an edge that stands for a chain may be parallel to another
                all_ = F.flatten(F.collect_list("via"))
                via = {"ancestors": F.when(F.count(F.lit(1)) == 1, F.first("via")).otherwise(_nearest(all_)), "roots": all_}.get(keep, none)
                after = after.groupBy("p", "c").agg(F.min("len").alias("len"), F.max("far").alias("far"), F.try_sum("ways").alias("ways"), via.alias("via"))
        before = size
        done.records.append(record)
        marked, size, chains = scratch.observed(_marked(after, carried), "marked", F.count(F.lit(1)), F.count_if(to_go))
        if size == before:
            break
    done.rest, done.rest_edges = marked.select("p", "c", *carried), size
    return done


def _marked(edges: DataFrame, carried: list[str]) -> DataFrame:
    """Edges (p, c, carried) with the number of children of c (c_o), and whether c (in_ok) and p (out_ok) are chain nodes that go in this
    round: their hash is below their neighbours', ids break ties. A chain node's child must not be raked at the same time."""
    degree = (
        edges.select(F.col("p").alias("node"), F.lit(0).alias("i"), F.lit(1).alias("o"))
        .unionByName(edges.select(F.col("c").alias("node"), F.lit(1).alias("i"), F.lit(0).alias("o")))
        .groupBy("node")
        .agg(F.sum("i").alias("i"), F.sum("o").alias("o"))
        .withColumn("chain", F.when((F.col("i") == 1) & (F.col("o") == 1), F.xxhash64("node")))
    )
    parent, child = (degree.select(F.col("node").alias(x), F.col("o").alias(f"{x}_o"), F.col("chain").alias(f"{x}_h")) for x in "pc")
    below = lambda a, b: F.coalesce((F.col(f"{a}_h") < F.col(f"{b}_h")) | ((F.col(f"{a}_h") == F.col(f"{b}_h")) & (F.col(a) < F.col(b))), F.lit(True))
    return edges.join(parent, "p").join(child, "c").select(
        "p", "c", *carried, "c_o",
        (F.col("c_h").isNotNull() & (F.col("p") != F.col("c")) & below("c", "p")).alias("in_ok"),
        (F.col("p_h").isNotNull() & (F.col("p") != F.col("c")) & (F.col("c_o") > 0) & below("p", "c")).alias("out_ok"),
    )


def _united(keep: str) -> list[Column]:
    """What the edge that stands for a removed node carries: that of the edge into it (1) and out of it (2)."""
    if keep in ("paths", "roots"):
        via = F.concat("via1", F.array("x"), "via2")
    elif keep == "ancestors":
        further = F.transform("via1", lambda e: F.struct(e["anc"].alias("anc"), (e["near"] + F.col("len2")).alias("near")))
        via = F.concat(further, F.array(F.struct(F.col("x").alias("anc"), F.col("len2").alias("near"))), "via2")
    else:
        via = F.array().cast(_VIA[keep])
    return [(F.col("len1") + F.col("len2")).alias("len"), (F.col("far1") + F.col("far2")).alias("far"), F.try_multiply("ways1", "ways2").alias("ways"), via.alias("via")]


def _nearest(via: Column) -> Column:
    """Of structs (anc, near), each anc once with its least near: the first of it in their order."""
    return F.aggregate(
        F.array_sort(via), F.array().cast(_VIA["ancestors"]),
        lambda held, e: F.when((F.size(held) > 0) & (F.element_at(held, -1)["anc"] == e["anc"]), held).otherwise(F.concat(held, F.array(e))),
    )


def components(rest: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, comp, cyclic) of the core: its strong components; cyclic if a node can come back to itself.

    By colouring: the greatest id that reaches a node is its colour; what reaches the colour's node
    within the colour is its component. Repeated on what remains, after trimming nodes without parents or children."""
    loops = scratch.write(rest.where("p = c").select(F.col("p").alias("node")).distinct(), "loops")
    now, size = scratch.counted(rest.where("p <> c").select("p", "c").distinct(), "core")
    found: list[DataFrame] = []
    while size:
        before = None
        while size and size != before:  # trim
            before = size
            ends = now.select(F.col("p").alias("n")).distinct().join(now.select(F.col("c").alias("n")).distinct(), "n")
            now, size = scratch.counted(now.join(ends.withColumnRenamed("n", "p"), "p", "left_semi").join(ends.withColumnRenamed("n", "c"), "c", "left_semi"), "core")
        if not size:
            break
        colour = scratch.write(now.select(F.col("p").alias("node"), F.col("p").alias("k"), F.lit(True).alias("new")).distinct(), "colour")
        changed = 1
        while changed:
            sent = now.join(colour.where("new"), now.p == colour.node).select(F.col("c").alias("node"), "k")
            higher = colour.select("node", "k", F.col("k").alias("old")).unionByName(sent.withColumn("old", F.lit(None).cast("string")))
            higher = higher.groupBy("node").agg(F.max("k").alias("k"), (F.max("k") > F.max("old")).alias("new"))
            colour = scratch.write(higher, "colour")
            changed = colour.where("new").count()
        kc = colour.select(F.col("node").alias("c"), F.col("k").alias("kc"))
        within = scratch.write(now.join(colour.select(F.col("node").alias("p"), "k"), "p").join(kc, "c").where("k = kc").select("p", "c", "k"), "within")
        front, n = scratch.counted(colour.where("node = k").select("node", "k"), "front")
        inside = front
        while n:
            back = within.join(front.select(F.col("node").alias("c"), F.col("k").alias("fk")), "c").where("k = fk").select(F.col("p").alias("node"), "k").distinct()
            front, n = scratch.counted(back.join(inside, ["node", "k"], "left_anti"), "front")
            if n:
                inside = scratch.write(inside.unionByName(front), "inside")
        group = inside.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("comp"))
        part = scratch.write(inside.join(group, "k").where("n > 1").select("node", "comp", F.lit(True).alias("cyclic")), "part")
        found.append(part)
        seen = inside.select("node")
        now, size = scratch.counted(now.join(seen.withColumnRenamed("node", "p"), "p", "left_anti").join(seen.withColumnRenamed("node", "c"), "c", "left_anti"), "core")
    everyone = rest.select(F.col("p").alias("node")).union(rest.select(F.col("c").alias("node"))).distinct()
    labelled = found[0] if found else None
    for part in found[1:]:
        labelled = labelled.unionByName(part)
    if labelled is None:
        labelled = everyone.limit(0).select("node", F.col("node").alias("comp"), F.lit(True).alias("cyclic"))
    full = everyone.join(labelled, "node", "left").join(loops.withColumn("loop", F.lit(True)), "node", "left")
    return scratch.write(full.select("node", F.coalesce("comp", "node").alias("comp"), (F.coalesce("cyclic", F.lit(False)) | F.coalesce("loop", F.lit(False))).alias("cyclic")), "components")


def cycle_nodes(done: Contraction) -> DataFrame:
    """The nodes that can be reached from themselves. For ``keep="roots"`` or ``"ancestors"``.

    Raked nodes are on no cycle. A node compressed away is on one exactly if the edge that stands for it is left in the core and its ends
    are in one component; chains that were compressed onto one node show there as a loop. Without a core there are none.
    """
    if not done.rest_edges:
        return done.nodes.limit(0)
    label = components(done.rest, done.scratch)
    head, tail = (label.select(F.col("node").alias(a), F.col("comp").alias(b)) for a, b in (("p", "comp"), ("c", "comp2")))
    names = F.col("via") if done.rest.schema["via"].dataType.simpleString() == "array<string>" else F.transform("via", lambda e: e["anc"])
    within = done.rest.withColumn("names", names).where("size(names) > 0").join(head, "p").join(tail, "c").where("comp = comp2").select(F.explode("names").alias("node"))
    return done.scratch.write(label.where("cyclic").select("node").unionByName(within).distinct(), "cyclic")


def roots_above(done: Contraction) -> DataFrame:
    """(node, root, near): the roots each node can be reached from (a root: itself) and the least number of steps.

    Nodes below or on cycles get the roots beyond; nodes that no root reaches have no row.
    """
    start = done.sources.select("node", F.col("node").alias("root"), F.lit(0).cast("bigint").alias("near"))
    inside = _ends(done.rest)
    rest = done.rest.groupBy("p", "c").agg(F.min("len").alias("len"))
    info = start
    if done.rest_edges:
        info = start.join(inside, "node", "left_anti").unionByName(_spread(start.join(inside, "node", "left_semi"), rest, "root", done.scratch))
    give = lambda record, known: record.join(known.withColumnRenamed("node", "parent"), "parent").select("node", "root", (F.col("near") + F.col("len")).alias("near"))
    return _reversed(done, info, lambda record, known: give(record, known).groupBy("node", "root").agg(F.min("near").alias("near")))


def ancestors(done: Contraction) -> DataFrame:
    """(node, anc, near): all ancestors of each node, and itself, with the least number of steps; ends on cycles too.

    Seen from anc: all descendants. For ``keep="ancestors"``.
    """
    zero = F.lit(0).cast("bigint").alias("near")
    start = done.nodes.select("node", F.col("node").alias("anc"), zero)
    removed = [record.select("node") for record in done.records]
    if removed:
        start = start.join(_union(removed).distinct(), "node", "left_anti")
    info = start
    if done.rest_edges:
        inside = _ends(done.rest)
        on_edges = done.rest.select(F.col("c").alias("node"), F.explode("via").alias("e")).select("node", "e.anc", "e.near")
        facts = start.join(inside, "node", "left_semi").unionByName(on_edges).groupBy("node", "anc").agg(F.min("near").alias("near"))
        rest = done.rest.groupBy("p", "c").agg(F.min("len").alias("len"))
        info = start.join(inside, "node", "left_anti").unionByName(_spread(facts, rest, "anc", done.scratch))

    def give(record: DataFrame, known: DataFrame) -> DataFrame:
        from_parents = record.join(known.withColumnRenamed("node", "parent"), "parent").select("node", "anc", (F.col("near") + F.col("len")).alias("near"))
        own = record.select("node", F.col("node").alias("anc"), zero)
        between = record.select("node", F.explode("via").alias("e")).select("node", "e.anc", "e.near")
        return from_parents.unionByName(own).unionByName(between).groupBy("node", "anc").agg(F.min("near").alias("near"))

    return _reversed(done, info, give)


def _ends(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("p").alias("node")).union(edges.select(F.col("c").alias("node"))).distinct()


def _reversed(done: Contraction, info: DataFrame, give: Callable[[DataFrame, DataFrame], DataFrame]) -> DataFrame:
    """Undo the rounds, last first: the removed nodes get what ``give`` derives from the nodes known by then.

    What is known stands in at most PARTS tables besides the last one that united them.
    """
    parts = [done.scratch.write(info, "info")]
    for record in reversed(done.records):
        if len(parts) > PARTS:
            united = done.scratch.write(_union(parts), "known")
            done.scratch.drop(*parts)
            parts = [united]
        parts.append(done.scratch.write(give(record, _union(parts)), "info"))
    return _union(parts)


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _spread(facts: DataFrame, hops: DataFrame, what: str, scratch: Scratch) -> DataFrame:
    """Facts (node, what, near) carried along ``hops`` to a fixpoint; each step sends only what is new or nearer."""
    front = scratch.write(facts, "front")
    parts = [front]
    nearest = lambda tables: _union(tables).groupBy("node", what).agg(F.min("near").alias("near"))
    while True:
        sent = front.join(hops, front.node == hops.p).select(F.col("c").alias("node"), what, (F.col("near") + F.col("len")).alias("near"))
        sent = sent.groupBy("node", what).agg(F.min("near").alias("near"))
        old = nearest(parts).withColumnRenamed("near", "old")
        front, n = scratch.counted(sent.join(old, ["node", what], "left").where("old is null or near < old").select("node", what, "near"), "front")
        if not n:
            return nearest(parts)
        parts.append(front)
        if len(parts) > PARTS:
            parts = [scratch.write(nearest(parts), "known")]


def _free(nodes: DataFrame, edges: DataFrame, cyclic: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes and edges that touch no cycle, and the nodes that must not start a path: all their parents are on cycles."""
    free = nodes.join(cyclic, "node", "left_anti")
    kept = edges.join(cyclic.withColumnRenamed("node", "p"), "p", "left_anti").join(cyclic.withColumnRenamed("node", "c"), "c", "left_anti")
    return free, kept, edges.select(F.col("c").alias("node")).distinct()


def measures(nodes: DataFrame, edges: DataFrame, cyclic: DataFrame) -> DataFrame:
    """(node, depth, n_paths): the longest way from a root to the node that touches no cycle, and how many there are.

    As from ``root_paths``, but no path is written out: edges that stand for several ways carry their number and
    greatest length. n_paths is null beyond BIGINT. Nodes without such a way have no row.
    """
    free, kept, children = _free(nodes, edges, cyclic)
    done = contract(free, kept, "measures")
    one = F.lit(1).cast("bigint").alias("n_paths")
    start = done.sources.join(children, "node", "left_anti").select("node", F.lit(0).cast("bigint").alias("depth"), one)
    summed = [F.max("depth").alias("depth"), F.when(F.count("n_paths") == F.count(F.lit(1)), F.try_sum("n_paths")).alias("n_paths")]

    def give(record: DataFrame, known: DataFrame) -> DataFrame:
        longer = record.join(known.withColumnRenamed("node", "parent"), "parent")
        return longer.select("node", (F.col("depth") + F.col("far")).alias("depth"), F.try_multiply("n_paths", "ways").alias("n_paths")).groupBy("node").agg(*summed)

    info = start
    if done.rest_edges:  # without cycles: a front of ways, merged by node and depth, ends with the deepest
        front = known = done.scratch.write(start.join(_ends(done.rest), "node", "left_semi"), "front")
        while True:
            sent = front.join(done.rest, front.node == done.rest.p).select(F.col("c").alias("node"), (F.col("depth") + F.col("far")).alias("depth"), F.try_multiply("n_paths", "ways").alias("n_paths"))
            front = done.scratch.write(sent.groupBy("node", "depth").agg(summed[1]), "front")
            if front.isEmpty():
                break
            known = known.unionByName(front)
        info = start.join(_ends(done.rest), "node", "left_anti").unionByName(known.groupBy("node").agg(*summed))
    return _reversed(done, info, give)


def root_paths(nodes: DataFrame, edges: DataFrame, cyclic: DataFrame, max_rounds: int = MAX_ROUNDS) -> DataFrame:
    """(node, path, depth): every way from a root to the node, both included, that touches no cycle; depth is its steps.

    Nodes on cycles, and nodes only reachable through one, have no row. Without them the graph contracts completely; what
    is left after ``max_rounds`` is walked by a front of paths, level by level.
    """
    free, kept, children = _free(nodes, edges, cyclic)
    done = contract(free, kept, "paths", max_rounds)
    # A node whose parents are all on cycles has lost them here; it is no root and starts no path.
    start = done.sources.join(children, "node", "left_anti").select("node", F.array("node").alias("path"))
    info = start
    if done.rest_edges:
        inside = _ends(done.rest)
        front = done.scratch.write(start.join(inside, "node", "left_semi"), "front")
        info = start.join(inside, "node", "left_anti")
        while not front.isEmpty():
            info = info.unionByName(front)
            longer = front.join(done.rest, front.node == done.rest.p).select(F.col("c").alias("node"), F.concat("path", "via", F.array("c")).alias("path"))
            front = done.scratch.write(longer, "front")
    longer = lambda record, known: record.join(known.withColumnRenamed("node", "parent"), "parent").select("node", F.concat("path", "via", F.array("node")).alias("path"))
    return _reversed(done, info, longer).withColumn("depth", (F.size("path") - 1).cast("bigint"))
