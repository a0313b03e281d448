"""Contraction against brute force: random graphs with several parents, cycles, self-loops, chains and dangling ids."""

from __future__ import annotations

import random

import pytest

from scenarium.operators import hierarchy as H

SCHEMA = "id string, child_ids array<string>"


def brute(rows):
    ids = {i for i, _ in rows if i is not None}
    below = {i: {c for j, cs in rows if j == i for c in cs or [] if c in ids} for i in ids}
    into = {c for cs in below.values() for c in cs}

    def reached(start):
        seen, work = set(), list(below[start])
        while work:
            v = work.pop()
            if v not in seen:
                seen.add(v)
                work += below[v]
        return seen

    reach = {i: reached(i) for i in ids}
    cyclic = {i for i in ids if i in reach[i]}
    roots = ids - into
    tops = {(v, r) for r in roots for v in reach[r] | {r}}
    closure = {}
    for a in ids:
        front, steps = {a}, 0
        while front:
            closure |= {(v, a): steps for v in front}
            front, steps = {c for v in front for c in below[v]} - {v for v in ids if (v, a) in closure}, steps + 1
    paths, work = [], [(r,) for r in roots]
    while work:
        p = work.pop()
        paths.append(p)
        work += [(*p, c) for c in below[p[-1]] if c not in cyclic]
    return cyclic, tops, closure, sorted(paths)


def graph(seed):
    rng = random.Random(seed)
    n = 40
    rows = [(f"n{i}", [f"n{rng.randrange(i + 1, n)}" for _ in range(rng.choice([0, 1, 1, 2]))] if i < n - 1 else None) for i in range(n)]
    rows += [(f"c{i}", [f"c{i + 1}"]) for i in range(30)] + [("c30", ["n20"]), ("n3", ["c0", "c0", "gone", None])]  # a long chain
    rows += [("x0", ["x1"]), ("x1", ["x2", "n30"]), ("x2", ["x0"]), ("n5", ["x1"]), ("s", ["s", "n31"]), ("y0", ["y1"]), ("y1", ["y0"]), ("lone", [])]
    rows += [("z0", ["z1", "z2"]), ("z1", ["z3"]), ("z2", ["z3"]), ("z3", ["z0", "z4"]), ("z4", ["z5"]), ("z5", ["z6"]), ("z6", ["z5", "n32"])]
    return rows + [rows[0], (None, ["n1"])]


@pytest.mark.parametrize(("seed", "rounds"), [(1, 100), (2, 2)])
def test_contraction(spark, seed, rounds):
    rows = graph(seed)
    cyclic, tops, closure, paths = brute(rows)
    nodes, edges = H.edges_of(spark.createDataFrame(rows, SCHEMA))
    done = H.contract(nodes, edges, "ancestors", rounds)
    found = H.cycle_nodes(done)
    assert {r.node for r in found.collect()} == cyclic
    got = H.roots_above(done).collect()
    assert {(r.node, r.root) for r in got} == tops and len(got) == len(tops)
    got = H.ancestors(done).collect()
    assert {(r.node, r.anc): r.near for r in got} == closure and len(got) == len(closure)
    assert sorted(tuple(r.path) for r in H.root_paths(nodes, edges, found, rounds).collect()) == paths
    ways = {r.node: (r.depth, r.n_paths) for r in H.measures(nodes, edges, found).collect()}
    ends = [p[-1] for p in paths]
    assert ways == {v: (max(len(p) - 1 for p in paths if p[-1] == v), ends.count(v)) for v in set(ends)}


def test_second_parents(spark):
    """A spine whose nodes each have a second parent, a root, loses one level a round; beyond the rounds its paths are walked."""
    rows = [(f"s{i:02}", [f"s{i + 1:02}"]) for i in range(20)] + [("s20", [])] + [(f"r{i:02}", [f"s{i:02}"]) for i in range(1, 21)]
    nodes, edges = H.edges_of(spark.createDataFrame(rows, SCHEMA))
    none = nodes.limit(0)
    for rounds in (5, 100):
        paths = [tuple(r.path) for r in H.root_paths(nodes, edges, none, rounds).collect()]
        assert sorted(paths) == brute(rows)[3] and len(paths) == 251
    assert H.cycle_nodes(H.contract(nodes, edges, "roots", 5)).count() == 0


def test_empty_and_null(spark):
    nodes, edges = H.edges_of(spark.createDataFrame([(None, None), ("a", None), ("a", [None, ""])], SCHEMA))
    done = H.contract(nodes, edges)
    assert [tuple(r) for r in H.roots_above(done).collect()] == [("a", "a", 0)]
    assert H.cycle_nodes(done).count() == 0
    nodes, edges = H.edges_of(spark.createDataFrame([], SCHEMA))
    assert H.roots_above(H.contract(nodes, edges)).count() == 0
