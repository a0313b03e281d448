"""Edge cases of drift, nested records and orphans."""

from __future__ import annotations

import json
import random
from datetime import datetime, timedelta

import numpy as np
from pyspark.sql import functions as F

from scenarium.operators import drift, nested, orphans

DAY = datetime(2024, 1, 1)
FILES = "producer string, batch_id bigint, body string, written_at timestamp_ntz, file_id bigint, n bigint, path string"


def files(spark, batches):
    """batches: (producer, batch_id, day, bodies)"""
    rows, k = [], 0
    for producer, batch, day, bodies in batches:
        for b in bodies:
            k += 1
            rows.append((producer, batch, json.dumps(b) if not isinstance(b, (str, type(None))) else b, DAY + timedelta(days=day) if day is not None else None, k, 1, "x"))
    return spark.createDataFrame(rows, FILES)


def core(**x):
    return {"core": {"image_id": "1", "visual_terms": [], **x}}


def node(**x):
    return {"node_id": "n1", "confidence": 0.5, **x}


def test_changes(spark):
    df = files(
        spark,
        [
            ("p", 9, 0, [core(nodes=[node(title="Dog bark")]), None, "", "{", "null"]),
            ("p", 3, 1, [core(nodes=[node(audioset_name="Dog bark", extra=None)])]),  # renamed by the alias table; null is absent
            ("p", 5, 2, [core(nodes=[node(audioset_name="x", confidence="0.5")])]),  # type
            ("p", 1, 3, [core(audioset_nodes={"k1": node(audioset_name="x", confidence="0.5", new=True)}), "{", core(audioset_nodes={"k1": {}})]),  # container: gone and come, as its type differs
            ("p", 7, 4, [core(audioset_nodes={"k1": node(audioset_name="x", confidence="0.5", new=True)}, acoustic_caption="a b.")]),
            ("p", 8, 5, [core(audioset_nodes={"k1": node(audioset_name="x", confidence="0.5", newer=True)}, sound_caption="c d.")]),  # unknown names, same kind
            ("p", 2, 6, [core(semantic_nodes={"k1": node(audioset_name="x", confidence="0.5", newer=True, other=1)}, sound_caption={"text": "c"})]),
            ("q", 1, 0, [core(entities=[{"id": "e1"}, "text", None])]),
            ("q", 2, 1, [core(entities=[])]),
            ("one", 1, 0, [core(entities=[])]),
            (None, 1, 0, [core(entities=[])]),
        ],
    )
    want = {
        ("p", 3, "nodes[].title", "renamed", "nodes[].audioset_name"),
        ("p", 5, "nodes[].confidence", "type", ""),
        ("p", 1, "nodes", "removed", ""),
        ("p", 1, "audioset_nodes", "added", ""),
        ("p", 7, "acoustic_caption", "added", ""),
        ("p", 8, "acoustic_caption", "renamed", "sound_caption"),
        ("p", 8, "audioset_nodes[].new", "renamed", "audioset_nodes[].newer"),
        ("p", 2, "audioset_nodes", "renamed", "semantic_nodes"),
        ("p", 2, "sound_caption", "type", ""),
        ("q", 2, "entities[].id", "removed", ""),
    }
    for block in (2, 4096):
        got = [tuple(r) for r in drift.changes(df, block).collect()]
        assert set(got) == want and len(got) == len(want)
    assert drift.changes(df.limit(0)).count() == 0
    spans = {(r.path, r.type): (r.from_batch, r.to_batch, r.batches) for r in drift.lifespans(df, 2).where("producer = 'p'").collect()}
    assert spans[("nodes", "array")] == (9, 5, 3) and spans[("sound_caption", "object")] == (2, 2, 1)
    one = drift.consistent(df.unionByName(df))
    assert one.where("kind = 'acoustic_caption'").orderBy("file_id").select("text").collect()[0].text == "a b."
    assert one.where("label = 'Dog bark'").count() == 2 and one.where("confidence = 0.5").count() == 7


def test_unknown_names(spark):
    """All renames of a batch are found, by values where kinds can't tell; shapes count whole, and length is no kind."""
    deep = {f"member_with_a_long_name_{k}": 1 for k in range(4)}
    long = "word " * 40
    old = [node(alpha=f"red {k}", beta=f"blue {k}", shape=deep, note=long, gone="A sentence.") for k in range(4)]
    new = [node(gamma=f"red {k}", delta=f"blue {k}", form={**deep, "member_with_a_long_name_3": "x"}, remark="two words", come=1) for k in range(4)]
    df = files(spark, [("p", 1, 0, [core(nodes=old)]), ("p", 2, 1, [core(nodes=new)])])
    f = lambda x: f"nodes[].{x}"
    want = {(f("alpha"), "renamed", f("gamma")), (f("beta"), "renamed", f("delta")), (f("note"), "renamed", f("remark")), (f("shape"), "removed", ""), (f("form"), "added", ""), (f("gone"), "removed", ""), (f("come"), "added", "")}
    assert {(r.field, r.change, r.new_field) for r in drift.changes(df).collect()} == want
    # Fields that nothing tells apart are still paired one to one.
    df = files(spark, [("p", 1, 0, [core(nodes=[node(a=1.5, b=2.5)])]), ("p", 2, 1, [core(nodes=[node(c=3.5, d=4.5)])])])
    assert {(r.field, r.new_field) for r in drift.changes(df).collect()} == {(f("a"), f("c")), (f("b"), f("d"))}


def test_vocabulary(spark):
    """Names are a parameter: columns and casts are made from the alias table given."""
    own = drift.Vocabulary(containers={"things": ["stuff"]}, fields={"weight": ("kg", "number", ["mass"]), "title": ("name", "text", [])})
    df = files(spark, [("p", 1, 0, [core(stuff=[{"mass": "1.5", "title": {"text": "x"}, "else": 1}], nodes=[{"title": "y"}])])])
    a, b = drift.consistent(df, known=own).orderBy("kind").collect()
    assert (a.kind, a.name, a.kg) == ("node", "y", None) and (b.kind, b.name, b.kg, b.rest) == ("things", "x", 1.5, {"else": "1"})


def test_list_forms(spark):
    forms = [["a", "b"], {"items": ["a", "b"]}, "a|b", "a", [], {"items": []}, {"other": 1}, None]
    df = files(spark, [("p", 1, 0, [core(nodes=[node(visual_evidence_terms=x, parents=x, topLevelIds=x) for x in forms])])])
    got = drift.consistent(df).orderBy("pos").select("terms", "parent_ids", "top_level_ids").collect()
    assert [tuple(r) for r in got] == [(x, x, x) for x in (["a", "b"], ["a", "b"], ["a", "b"], ["a"], [], [], None, None)]


def test_all_members(spark):
    one = node(mid={"text": "/m/1"}, bbox="1.5|2|3|4", is_crowd=1, is_abstract="false", mask_rle='{"start": 2, "end": 5}', evidence_span={"start": 1, "end": 4}, track_id=["t1"], aliases="a|b", salience="0.5", new={"k": [1]}, none=None)
    two = node(audioset_id="/m/2", id="e1", name="both", audioset_name="first", bbox=[1, "x"], instance_count="many", rank_in_image={"value": 3}, source="s")
    a, b = drift.consistent(files(spark, [("p", 1, 0, [core(nodes=[one, two])])])).orderBy("pos").collect()
    assert (a.audioset_id, a.bbox, a.is_crowd, a.is_abstract, a.track_id, a.aliases, a.salience) == ("/m/1", [1.5, 2, 3, 4], True, False, "t1", ["a", "b"], 0.5)
    assert tuple(a.mask_rle) == (2, 5) and tuple(a.evidence_span) == (1, 4) and a.rest == {"new": '{"k":[1]}'}
    assert (b.audioset_id, b.id, b.label, b.bbox, b.instance_count, b.rank_in_image, b.source) == ("/m/2", "n1", "first", None, None, 3, "s")
    assert b.rest == {"id": '"e1"', "name": '"both"', "bbox": '[1,"x"]', "instance_count": '"many"'}


def test_nested(spark):
    body = {
        "core": {"nodes": [None, {"node_id": "a", "visual_evidence_terms": ["x", None, ""]}, {"node_id": "a"}, "text", {"node_id": None}], "visual_terms": ["t", None, " "]},
        "extended": {"grounding": [{"node_id": "a", "bbox": [1, 2, 3, 4]}, None, {"node_id": "q"}, {"node_id": None}], "global_geometry": {"category_counts": {"human": 2, "animal": None}}},
        "history": [{"nodes": [{"node_id": "z"}]}],
    }
    text = json.dumps(body)
    rows = [(1, text), (2, "﻿" + text), (3, json.dumps(text)), (4, f"```json\n{text}\n```"), (5, None), (6, ""), (7, "[]"), (8, "null"), (9, text[:-3]), (10, '{"core": {}}'), (11, '{"a": 1, "a": 2}'), (1, text)]
    df = spark.createDataFrame([(*r, 1, "y") for r in rows], "nested_id bigint, body string, nodes int, rel string")
    got = nested.supertype(nested.classified(nested.children(df, "nested_id", "body")), "nested_id")
    want = {("node", "1", ""), ("node", "2", ""), ("node", "3", ""), ("node", "4", ""), ("node_term", "1.0", "1"), ("node_term", "1.2", "1"), ("visual_term", "0", ""), ("visual_term", "2", "")}
    want |= {("grounding", "0", "1"), ("grounding", "2", ""), ("grounding", "3", ""), ("category_count", "human", ""), ("category_count", "animal", "")}
    by = {}
    for r in got.collect():
        assert (r.rel, r.pos, r.parent) not in by.setdefault(r.nested_id, set())
        by[r.nested_id].add((r.rel, r.pos, r.parent))
    assert by == {k: want for k in (1, 2, 3, 4)}
    kinds = nested.classified(nested.children(df, "nested_id", "body")).where("nested_id = 2")
    assert {(r.pos, r.variant) for r in kinds.where("rel = 'node'").collect()} == {("1", "node"), ("2", "node"), ("3", "irregular"), ("4", "anonymous_node")}
    assert nested.subtype(kinds, "nested_id", "grounding", "box").first().bbox == [1.0, 2.0, 3.0, 4.0]
    assert nested.subtype(kinds, "nested_id", "node", "irregular").first().json == '"text"'
    assert nested.supertype(nested.classified(nested.children(df.limit(0), "nested_id", "body")), "nested_id").count() == 0


def test_bloom():
    rng = np.random.default_rng(1)
    keys = rng.integers(-(2**63), 2**63 - 1, 2000)
    bits = np.zeros(4096, dtype=np.uint8)
    for at in orphans.places(keys, len(bits) * 8):
        np.bitwise_or.at(bits, at >> 3, np.left_shift(np.uint8(1), (at & 7).astype(np.uint8)))
    bloom = orphans.Bloom(bits)
    assert bloom.might_contain(keys).all()
    assert bloom.might_contain(rng.integers(-(2**63), 2**63 - 1, 2000)).mean() < 0.1


def test_orphans(spark):
    t = lambda d: DAY + timedelta(days=d) if d is not None else None
    parents = [(1, "N1", t(0), None), (1, "n2", t(5), None), (1, "n3", t(0), t(2)), (1, None, t(0), None), (None, "n1", t(0), None), (2, " n1 ", t(0), t(1)), (2, "n1", t(3), t(9)), (3, "x", None, None)]
    refs = [(1, " n1 ", t(1)), (1, "n2", t(4)), (1, "n2", t(5)), (1, "n3", t(1)), (1, "n3", t(2)), (1, "zz", t(1)), (1, "", t(1)), (1, None, t(1)), (9, "n1", t(1)), (2, "n1", t(2)), (2, "n1", t(9)), (None, "n1", t(1)), (3, "X", None)]
    p = spark.createDataFrame(parents, "scope bigint, key string, arrived timestamp_ntz, deleted timestamp_ntz")
    r = spark.createDataFrame([(i, *x, "c") for i, x in enumerate(refs)], "row bigint, scope bigint, key string, arrived timestamp_ntz, bits string")
    want = {(1, "late"), (4, "deleted"), (5, "missing"), (8, "missing"), (10, "deleted"), (11, "missing")}
    for size in (16, 1 << 20):  # a filter that lets everything through changes nothing
        got = [(x.row, x.status) for x in orphans.find_orphans(r, p, size).collect()]
        assert set(got) == want and len(got) == len(want)
    assert orphans.find_orphans(r, p.limit(0)).count() == 11
    assert orphans.find_orphans(r.limit(0), p).count() == 0
    # Deliveries of one reference: the first one counts, whatever the later ones would give.
    again = spark.createDataFrame([(1, 1, "n2", t(4)), (1, 1, "n2", t(6)), (2, 1, "n3", t(1)), (2, 1, "n3", t(3)), (3, 1, "zz", t(9)), (3, 1, "zz", t(2))], "row bigint, scope bigint, key string, arrived timestamp_ntz")
    for size in (16, 1 << 20):
        assert {(x.row, x.status, x.arrived) for x in orphans.find_orphans(again, p, size, ["row"]).collect()} == {(1, "late", t(4)), (3, "missing", t(2))}
    assert orphans.filter_bytes(0) == 1 << 14 and orphans.filter_bytes(1_000_000) == 1 << 21 and orphans.filter_bytes(1 << 40) == 64 << 20


def test_islands(spark):
    rng = random.Random(5)
    ns = sorted(rng.sample(range(1, 60), 40))
    df = spark.createDataFrame([("k", n) for n in ns], "key string, n bigint")
    for block in (3, 7, 100):
        got = {r.n: (r.starts, r.ends) for r in drift.islands(df, ["key"], block=block).collect()}
        assert got == {n: (n - 1 not in ns, n + 1 not in ns) for n in ns}
