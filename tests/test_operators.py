"""Golden cases and brute force for the evaluation's operators."""

from __future__ import annotations

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from scenarium.functions.text import canonical
from scenarium.operators import captionmetrics, captions, families, fusion, hierarchy, metrics, ontology, payload, providers, reports, rules, suppression

BOX = "key string, id bigint, ord bigint, label string, confidence double, x1 double, y1 double, x2 double, y2 double"


def iou(a, b):
    w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    inter = max(0, w) * max(0, h)
    area = lambda x: max(0, x[2] - x[0]) * max(0, x[3] - x[1])
    union = area(a) + area(b) - inter
    return inter / union if union > 0 else 0.0


def test_nms_chain(spark):
    rows = spark.createDataFrame([("i", 1, 0, "a", 0.9, 0.0, 0.0, 10.0, 10.0), ("i", 2, 1, "a", 0.8, 2.0, 0.0, 12.0, 10.0), ("i", 3, 2, "a", 0.7, 4.0, 0.0, 14.0, 10.0)], BOX)
    assert {r.id for r in suppression.nms(rows, 0.5).collect()} == {1, 3}
    assert suppression.nms(rows.limit(0), 0.5).count() == 0


@pytest.mark.parametrize("block", [7, 4000])
def test_nms_brute(spark, block):
    rng = random.Random(3)
    rows = []
    for i in range(240):  # one image has most boxes; ties in confidence, swapped sides, null confidence, a null image
        x, y = rng.uniform(0, 60), rng.uniform(0, 60)
        key = rng.choice(["hot"] * 8 + ["b", None])
        w = rng.uniform(-2, 40)
        rows.append((key, i, rng.randrange(5), rng.choice(["man", "person", "cow", "horse", "sofa"]), rng.choice([0.5, 0.9, None, rng.random()]), x, y, x + w, y + 20.0))
    by: dict = {}
    for r in rows:
        by.setdefault(r[0], []).append(r)
    order = lambda r: (-(r[4] if r[4] is not None else -1.0), r[2], r[1])
    want, alias = set(), set()
    groups = {"man": 0, "person": 0, "cow": 1, "horse": 1}
    inside = lambda a, b: iou_part(a, b)
    for part in by.values():
        kept, kept2 = [], []
        for r in sorted(part, key=order):
            if all(iou(r[5:], k[5:]) < 0.4 for k in kept):
                kept.append(r)
            g = groups.get(r[3])
            bad = [k for k in kept2 if g is not None and groups.get(k[3]) == g and ((iou(r[5:], k[5:]) >= 0.75) if g == 0 else (iou(r[5:], k[5:]) >= 0.3 or inside(r[5:], k[5:]) >= 0.65 or inside(k[5:], r[5:]) >= 0.65))]
            if not bad:
                kept2.append(r)
        want |= {r[1] for r in kept}
        alias |= {r[1] for r in kept2}
    df = spark.createDataFrame(rows, BOX)
    got = suppression.nms(df, 0.4, block).collect()
    assert {r.id for r in got} == want and len(got) == len(want)
    assert {r.id for r in suppression.alias_suppression(df, block=block).collect()} == alias


def iou_part(a, b):
    inter = max(0, min(a[2], b[2]) - max(a[0], b[0])) * max(0, min(a[3], b[3]) - max(a[1], b[1]))
    area = max(0, a[2] - a[0]) * max(0, a[3] - a[1])
    return inter / area if area > 0 else 0.0


def test_suppressed_pipeline(spark):
    rows = spark.createDataFrame([("i", 1, 0, "Man", 0.9, 0.0, 0.0, 10.0, 10.0), ("i", 2, 1, "person", 0.8, 0.0, 0.0, 10.0, 9.0), ("i", 3, 2, "dog", 0.1, 50.0, 0.0, 60.0, 9.0)], BOX)
    assert {r.id for r in suppression.suppressed(rows).collect()} == {1}


def test_set_metrics(spark):
    row = lambda p, r: spark.range(1).select(*[c.alias(n) for n, c in metrics.set_prf(F.array(*map(F.lit, p)).cast("array<string>"), F.array(*map(F.lit, r)).cast("array<string>")).items()]).first()
    assert tuple(row("ab", "bcd")) == pytest.approx((0.5, 1 / 3, 0.4))
    assert tuple(row("", "")) == (1, 1, 1) and tuple(row("a", "")) == (0, 0, 0)
    w = F.create_map(*[F.lit(x) for x in ("human", 1.0, "water", 0.9, "animal", 0.95)])
    got = spark.range(1).select(*metrics.weighted_prf(F.array(F.lit("human"), F.lit("water")), F.array(F.lit("human"), F.lit("animal")), w).values()).first()
    assert tuple(got) == pytest.approx((1 / 1.9, 1 / 1.95, 2 / 3.85))


def test_families(spark):
    count = lambda rows: spark.createDataFrame(rows, "k string, family string, n bigint")
    out = families.family_metrics(spark.createDataFrame([("x",), ("none",)], "k string"), count([("x", "human", 3), ("x", "water", 1)]), count([("x", "human", 2), ("x", "animal", 1)]), "k")
    r = {x.k: x for x in out.collect()}
    assert r["x"].count_bin_accuracy == pytest.approx(1 / 3) and r["x"].weighted_count_bin_accuracy == pytest.approx(1 / 2.85)
    assert r["x"].discrete_presence_recall == 0.5 and r["x"].weighted_discrete_presence_recall == pytest.approx(1 / 1.95)
    assert r["none"].count_bin_accuracy == 1.0 and r["none"].family_f1 == 1.0
    score = families.expected_share(count([("s", "human", 2), ("s", "vehicle", 1)]), spark.createDataFrame([("s", "religious_heritage"), ("t", None)], "k string, group string"), "k")
    assert {x.k: pytest.approx(x.score) for x in score.collect()} == {"s": 2 / 2.95, "t": 0.0}


DAG = [("R", ["A", "B"]), ("S", ["B"]), ("A", ["C"]), ("B", ["C", "E"]), ("C", ["D"]), ("D", []), ("E", None)]


def test_ontology(spark):
    raw = spark.createDataFrame([(i, c, i, []) for i, c in DAG], "id string, child_ids array<string>, name string, restrictions array<string>")
    one = ontology.integrity(raw).first()
    assert (one.n_nodes, one.n_roots, one.n_multi_parent, one.n_dangling, one.n_cyclic) == (7, 2, 2, 0, 0)
    nodes, edges = hierarchy.edges_of(raw)
    reach = hierarchy.ancestors(hierarchy.contract(nodes, edges, "ancestors"))
    paths = hierarchy.root_paths(nodes, edges, nodes.limit(0))
    depths = paths.groupBy("node").agg(F.max("depth").alias("depth"))
    assert {r.node: r.depth for r in depths.collect()} == {"R": 0, "S": 0, "A": 1, "B": 1, "C": 2, "D": 3, "E": 2}
    named = ontology.path_names(paths, ontology.nodes_table(raw))
    assert sorted(r.path for r in named.where("node = 'D'").collect()) == ["R > A > C > D", "R > B > C > D", "S > B > C > D"]
    pairs = spark.createDataFrame([(x, "D") for x in "DCAERS"] + [("A", "S"), ("R", "R")], "a string, b string")
    got = {(r.a, r.b): (r.lca, r.distance) for r in ontology.similarities(pairs, reach, depths).collect()}
    assert got[("D", "D")] == (1.0, 0) and got[("C", "D")] == (0.8, 1) and got[("A", "D")] == (0.5, 2) and got[("E", "D")] == (0.4, 3)
    assert got[("R", "D")] == (0.0, 3) and got[("S", "D")] == (0.0, 3) and got[("A", "S")] == (0.0, None) and got[("R", "R")] == (1.0, 0)
    tied = spark.createDataFrame([("X", ["U", "V"]), ("Y", ["U", "V"]), ("U", []), ("V", [])], "id string, child_ids array<string>")
    n2, e2 = hierarchy.edges_of(tied)
    up2, names = hierarchy.ancestors(hierarchy.contract(n2, e2, "ancestors")), spark.createDataFrame([("X", "z"), ("Y", "a")], "id string, name string")
    ask = spark.createDataFrame([("U", "V")], "a string, b string")
    assert ontology.similarities(ask, up2, depths.limit(0), names).first().lca_id == "X" and ontology.similarities(ask, up2, depths.limit(0)).first().lca_id == "Y"
    assert ontology.similarities(ask, up2, depths.limit(0)).first().lca == 1.0  # nodes without a depth have depth 0
    p, r = (spark.createDataFrame([("k", x) for x in xs], "key string, item string") for xs in ("D", "CE"))
    sim = ontology.similarities(spark.createDataFrame([("D", "C"), ("D", "E")], "a string, b string"), reach, depths)
    best = lambda c: metrics.best_pairwise(p, p, r, sim.select("a", "b", F.col(c).alias("s")), "key").first().similarity
    assert best("lca") == pytest.approx(2 / 3) and best("near") == pytest.approx(5 / 12)
    ups = {(x.node, x.parent) for x in ontology.parents_or_self(ontology.nodes_table(raw), edges).collect()}
    assert ("R", "R") in ups and ("C", "A") in ups and ("C", "B") in ups


def test_rules(spark):
    r = spark.createDataFrame([("X", "x", [["dog"]]), ("Y", "y", [["man"], ["microphone"]]), ("Z", "z", [["car", "bus"], ["road"]])], "rule_id string, name string, groups array<array<string>>")
    ev = spark.createDataFrame([("k", t) for t in ("dog", "bus", "road", "man", "dog")] + [("k", None)], "k string, term string")
    assert {x.rule_id for x in rules.fired(ev, r, "k").collect()} == {"X", "Z"}
    det = spark.createDataFrame([("k", "dog", 0.6), ("k", "dog", 0.9), ("k", "bus", 0.5), ("k", "road", 0.8)], "k string, term string, confidence double")
    got = {x.rule_id: x for x in rules.projected(det, r, "k").collect()}
    assert got["X"].confidence == 0.9 and got["X"].instance_count == 2 and got["Z"].confidence == 0.5 and got["Z"].instance_count is None
    assert (got["X"].node_id, got["Z"].node_id) == ("n1", "n2")
    nodes = spark.createDataFrame([("k", "n1", "X", ["dog"]), ("k", "n2", "Z", ["car"]), ("k", "n3", "Q", ["dog"]), ("k", "n4", "X", None)], "k string, node_id string, rule_id string, terms array<string>")
    assert rules.violations(nodes, r, "k").first().violations == 3
    lines = spark.createDataFrame(list(enumerate(["Dog|dog", "x", "FROM HERE", "Cat|cat", "TO HERE", "Cow|no", "Pig|pig or hog"])), "line_no bigint, line string")
    assert [x.name for x in rules.vocabulary(lines).orderBy("line_no").collect()] == ["Dog", "Pig"]
    built = rules.build(rules.vocabulary(lines), spark.createDataFrame([("dog", "d"), ("pig", "p")], "name string, id string"))
    assert {x.rule_id for x in built.collect()} == {"d", "p"}


def test_fusion(spark):
    rel = spark.createDataFrame([("i", "e1", "left_of", "e2", 0.5, 0), ("i", "e2", "right_of", "e1", 0.5, 1), ("i", "e2", "overlapping", "e1", 0.9, 2), ("i", "e1", "overlapping", "e2", 0.9, 3), ("i", "e1", "above", "e2", 0.2, 4)], "k string, subject_id string, relation string, object_id string, confidence double, ord int")
    assert sorted(r.ord for r in fusion.without_inverses(rel, "k").collect()) == [0, 2, 4]
    acts = spark.createDataFrame([("i", 0, "e1", "ride", "e2", 0.5), ("i", 1, "e1", "hold", "e2", 0.5), ("i", 2, "e2", "see", "e1", 0.1)], "k string, ord int, subject_id string, verb string, object_id string, confidence double")
    assert sorted(r.verb for r in fusion.top_interactions(acts, "k").collect()) == ["ride", "see"]
    b = spark.createDataFrame([("i", 7, 0.0, 0.0, 10.0, 10.0)], "k string, box_id bigint, x1 double, y1 double, x2 double, y2 double")
    c = spark.createDataFrame([("i", "m1", 0, 0.0, 0.0, 10.0, 2.0), ("i", "m2", 1, 0.0, 8.0, 10.0, 10.0)], "k string, match_id string, ord int, x1 double, y1 double, x2 double, y2 double")
    assert fusion.best_match(b, c, "k").first().match_id == "m1"
    assert fusion.best_match(b, c, "k", inclusive=False).count() == 0
    got = spark.range(1).select(fusion.semantic_importance(F.lit(0.7395703125), F.lit("human"), F.lit(0.0), F.lit(True)).alias("x")).first().x
    assert got == pytest.approx(0.6828)


def test_captions(spark):
    nodes = spark.createDataFrame([("k", "Dog", 0.5, 0, 1), ("k", "Owl, bird", 0.9, 1, 2), ("k", "Speech", 0.5, 2, None)], "k string, name string, confidence double, ord int, instance_count int")
    assert captions.acoustic_caption(nodes, "k").first().acoustic_caption == "owls, a dog, and speech would plausibly be heard."
    ents = spark.createDataFrame([("k", "e1", 0, "man", "human", 0.9, 1, 0.5), ("k", "e2", 1, "horse", "animal", 0.8, 2, 0.9), ("k", "e3", 2, "cart", "vehicle", 0.7, 1, None)], "k string, id string, ord int, label string, category string, confidence double, count_estimate int, importance double")
    acts = spark.createDataFrame([("k", 0, "e1", "riding", "e2"), ("k", 1, "e1", "see", "e9")], "k string, ord int, subject_id string, verb string, object_id string")
    rels = spark.createDataFrame([("k", "e1", "left_of", "e3", 0.4, 0), ("k", "e1", "overlapping", "e2", 0.9, 1)], "k string, subject_id string, relation string, object_id string, confidence double, ord int")
    scenes = spark.createDataFrame([("k", "rural_field", "outdoor")], "k string, label string, indoor_outdoor string")
    want = "The image shows an outdoor rural field scene. Visible elements include 2 horses, a man, and a cart. A man rides 2 horses. Additional contextual elements include cart. The man is to the left of the cart."
    assert captions.full_caption(scenes, ents, acts, rels, "k").first().caption == want
    assert "man left_of cart" in captions.caption_payload(ents, rels, "k").first().payload


def test_chair(spark):
    names = spark.createDataFrame([("bus",), ("keyboard",), ("computer keyboard",), ("street",), ("dog",)], "name string")
    text = "The image shows an outdoor street scene with two buses, computer keyboard, and dog."
    caps = spark.createDataFrame([("c", text), ("n", ""), ("r", "dog dog")], "k string, text string")
    clean = caps.select("k", captionmetrics.searched(F.col("text"), F.lit("street")).alias("text"))
    got = {r.k: r.mentioned for r in captionmetrics.mentions(clean, names, "k").collect()}
    assert got == {"c": ["bus", "computer keyboard", "dog"], "n": [], "r": ["dog"]}
    loose = {r.k: r.mentioned for r in captionmetrics.mentions_loose(caps, names, "k").collect()}
    assert loose["c"] == ["computer keyboard", "dog", "keyboard", "street"]
    score = lambda m: spark.range(1).select(captionmetrics.chair(F.array(*map(F.lit, m)), F.array(F.lit("bus"), F.lit("dog")))["chair_i"].alias("x")).first().x
    assert score(got["c"]) == pytest.approx(1 / 3) and score(loose["c"]) == 0.75
    voc = captionmetrics.vocabulary(spark.createDataFrame([("buses",), ("outdoor scene",), ("an",)], "object string"), ["an"])
    assert [r.name for r in voc.collect()] == ["bus"]


def by_hand(cands, refs, sigma=6.0):
    """The scorer's formula of one group, text by text. cands: id -> (image, by, words); refs: (image, by) -> words."""
    grams = lambda w, n: Counter(" ".join(w[i : i + n]) for i in range(len(w) - n + 1))
    sets = {k: [w for (i, b), w in refs.items() if i == image and b != by] for k, (image, by, _) in cands.items()}
    sets = {k: v for k, v in sets.items() if v}
    out = {}
    for k, others in sets.items():
        total = 0.0
        for w in others:
            for n in range(1, 5):
                df = lambda g: sum(any(g in grams(r, n) for r in v) for v in sets.values())  # noqa: B023, E731
                idf = lambda g: math.log(len(sets)) - math.log(max(1, df(g)))  # noqa: B023, E731
                c, r = ({g: tf * idf(g) for g, tf in grams(x, n).items()} for x in (cands[k][2], w))
                norm = math.sqrt(sum(x * x for x in c.values())) * math.sqrt(sum(x * x for x in r.values()))
                dot = sum(min(x, r[g]) * r[g] for g, x in c.items() if g in r)
                gap = max(len(cands[k][2]) - 1, 0) - max(len(w) - 1, 0)
                total += (dot / norm if norm else 0.0) * math.exp(-(gap**2) / (2 * sigma**2)) / 4
        out[k] = 10 * total / len(others)
    return out


def test_cider(spark):
    """Different lengths, repeated words and punctuation, against the formula by hand; groups don't mix."""
    texts = {
        ("1", "a"): "A dog, a dog and a DOG on the old street.", ("1", "b"): "A dog is on the street and the man walks it home after a long day.", ("1", "c"): "Two dogs.",
        ("2", "a"): "The man doesn't read, it's a man-made lake.", ("2", "b"): "A man does n't read by the lake.", ("3", "a"): "Ein Hund bellt 3.5 mal.", ("3", "c"): "", ("4", "a"): "alone",
    }
    rows = [("g", n, image, by, t) for n, ((image, by), t) in enumerate(texts.items()) if by == "a"] + [("h", 9, "1", "b", texts["1", "b"])]
    cand = spark.createDataFrame(rows, "g string, id bigint, image string, by string, text string")
    refs = spark.createDataFrame([(*k, t) for k, t in texts.items()], "image string, by string, text string")
    words = {k: r.w for (k, r) in zip(texts, spark.createDataFrame(list(enumerate(texts.values())), "n int, t string").select("n", captionmetrics.tokens(F.col("t")).alias("w")).orderBy("n").collect())}
    assert words["2", "a"] == ["the", "man", "does", "n't", "read", "it", "'s", "a", "man-made", "lake"] and words["3", "a"] == ["ein", "hund", "bellt", "3.5", "mal"]
    got = {r.id: r.cider for r in captionmetrics.cider(cand, refs, ["g"]).collect()}
    want = by_hand({i: (image, by, words[image, by]) for g, i, image, by, _ in rows if g == "g"}, words) | {9: 0.0}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want) and max(got.values()) > 0.05
    same = captionmetrics.cider(cand.where("g = 'g'"), refs.where("by = 'a'").withColumn("by", F.lit("z")), ["g"]).collect()
    assert all(r.cider == pytest.approx(10.0 if r.id != 5 else 0.0, abs=10) for r in same) and len(same) == 4
    assert captionmetrics.cider(cand.limit(0), refs, ["g"]).count() == 0


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ('x ```json\n{"core": {"scene": {"label": "street",}, "nodes": [],}}\n``` bye', '{"core": {"scene": {"label": "street"}, "nodes": []}}'),
        ('{"core": {"nodes": [], "x": {"nodes": []}', '{"nodes": []}'),
        ("{}", None),
        ("", None),
        ("no object", None),
        ('{"a": 1} {"caption": "x"}', '{"caption": "x"}'),
        ('{"caption": "one"} ```\n{"caption": "two"}\n```', '{"caption": "two"}'),
        ('{"caption": "one"} ```\n{"caption": "two"}', '{"caption": "one"}'),
        ('The {x} is [y {"core": "broken {"caption": "a } b", "nodes": [1,],}', '{"caption": "a } b", "nodes": [1]}'),
        ('[{"a": {"b": [{"caption": "deep"}]}}]', '{"caption": "deep"}'),
        ("{[" * 2000 + '{"caption": 1}', '{"caption": 1}'),
    ],
)
def test_best_object(text, want):
    got, error = payload.best_object(text)
    assert error is None or "\n" not in error
    assert got == want and (error is None) == (want is not None)


def test_payload(spark):
    body = """{"core": {"scene": {"label": " Old_Town "}, "entities": [{"id": "a", "label": "Man", "category": "x", "count_estimate": 0, "confidence": "2"}, 5, {"label": null}],
      "observed_interactions": [{"subject_id": "a", "object_id": "e2", "verb": ""}, {"subject_id": "a", "object_id": "a"}, {"subject_id": "z", "object_id": "a"}],
      "spatial_relations": [{"subject_id": "a", "object_id": "e2", "relation": "left_of"}, {"subject_id": "a", "object_id": "e2", "relation": "above"}]}, "caption": "hi"}"""
    cores = payload.with_core(spark.createDataFrame([("k", body), ("bad", "{"), ("null", None)], "k string, json string"), "k")
    row = cores.select(payload.scene_of(F.col("core")).alias("s"), payload.environment_of(F.col("core")).alias("e"), payload.with_period(F.col("caption")).alias("c")).first()
    assert tuple(row.s) == ("old town", "unknown", 0.5) and tuple(row.e) == ("unknown",) * 3 and row.c == "hi."
    ents = payload.legacy_entities(cores, "k")
    assert [(r.id, r.label, r.category, r.count_estimate, r.confidence) for r in ents.orderBy("id").collect()] == [("e1", "man", "human", 1, 1.0), ("e2", "object", "object", 1, 0.5)]
    acts = payload.legacy_edges(cores, ents, "k", "observed_interactions", "verb", "interact with").collect()
    assert [(r.subject_id, r.verb, r.object_id) for r in acts] == [("e1", "interact with", "e2")]
    rels = payload.legacy_edges(cores, ents, "k", "spatial_relations", "relation", None, payload.RELATIONS).collect()
    assert [r.relation for r in rels] == ["above"]


def test_audioset_nodes(spark):
    body = """{"core": {"visual_terms": ["Dog", "zzz"], "nodes": [{"audioset_name": "bark", "evidence": "e", "visual_evidence_terms": ["dog", "cat"]}, {"audioset_id": "/m/2", "evidence": "e", "visual_evidence_terms": ["cat"]},
      {"audioset_id": "/m/1", "evidence": "again", "visual_evidence_terms": ["dog"]}, {"audioset_id": "/m/1", "evidence": "", "visual_evidence_terms": ["dog"]}], "extra": 1}}"""
    cores = payload.with_core(spark.createDataFrame([("k", body)], "k string, json string"), "k")
    nodes = spark.createDataFrame([("/m/1", "Bark"), ("/m/2", "Meow")], "id string, name string")
    got = payload.audioset_nodes(cores, nodes, spark.createDataFrame([("dog",), ("cat",)], "term string"), "k").collect()
    assert [(r.node_id, r.audioset_id, r.terms) for r in got] == [("n1", "/m/1", ["dog"])]
    errors = cores.select(payload.core_errors(F.col("core")).alias("e")).first().e
    assert "unknown: extra" in errors and "missing: caption" in errors


def test_providers(spark):
    rows = spark.createDataFrame([(i, f"p{i}", None) for i in range(6)], "id bigint, prompt string, image string")

    def flaky(prompts, images):
        if any(p in ("p2", "p4") for p in prompts):
            raise ValueError("no")
        return providers.echo(prompts, images)

    got = providers.asked(rows, "id", flaky).collect()
    assert sorted(r.id for r in got if r.error) == [2, 4] and all(r.answer for r in got if not r.error)
    done = providers.with_retries(rows, "id", lambda df: providers.asked(df, "id", flaky), 1)
    assert done.count() == 6 and done.where("error is not null").count() == 2
    assert {r.id for r in providers.not_done(rows, done.where("error is null"), "id").collect()} == {2, 4}
    with pytest.raises(ValueError):
        providers.disjoint("/a/b", "/a")
    providers.disjoint("/a/b", "/a/bc")
    text = spark.range(1).select(providers.rule_text(F.array(F.array(F.lit("a"), F.lit("b")), F.array(F.lit("c")))).alias("r"), providers.prompt("map_terms", terms=F.array(F.lit("x"), F.lit("y"))).alias("p")).first()
    assert text.r == "(a OR b) AND c" and text.p.endswith("Terms: x, y.")
    assert len(providers.hashed_vectors(["a b", ""])[0]) == 64


def test_reports(spark):
    with pytest.raises(ValueError, match="CIDEr"):
        reports.metric_group(spark.range(1), "caption")
    assert len(reports.sweep(detector=["a", "b"], scene=[1, 2])) == 4
    a = spark.createDataFrame([("x", 5, 4), ("y", 3, 3)], "image_id string, n_raw bigint, n_filtered bigint")
    b = spark.createDataFrame([("x", 5, 1), ("z", 1, 1)], "image_id string, n_raw bigint, n_filtered bigint")
    both, gone, new = suppression.count_differences(a, b)
    assert both.first().filtered_delta == -3 and gone.first().image_id == "y" and new.first().image_id == "z"
    assert reports.biggest_drops(both).count() == 1 and reports.summary(both).first().mean_delta == -3


def test_canonical(spark):
    m = F.create_map(F.lit("bike"), F.lit("bicycle"))
    assert spark.range(1).select(canonical(F.lit(" Bike!"), m).alias("x")).first().x == "bicycle"


def test_assembly(spark):
    from scenarium.operators import assembly

    labels = spark.createDataFrame([("dog",), ("big red dogs",), ("sofa",), (None,)], "label string")
    got = {r.label: r.t for r in labels.select("label", assembly.tags(F.col("label"), {"dog": ["T1"], "red dog": ["T2", "T1"], "o": []}).alias("t")).collect()}
    assert got == {"dog": ["T1"], "big red dogs": ["T1", "T2"], "sofa": [], None: []} or got[None] is None
    stored, fired, usable = (spark.createDataFrame([("k", x) for x in xs], "k string, rule_id string") for xs in ("ab", "bc", "abc"))
    pick = lambda s: {r.rule_id for r in assembly.predicted_nodes(stored, fired, usable.where("rule_id <> 'a'"), "k", s).collect()}
    assert pick("core_nodes") == {"b"} and pick("core_rules") == {"b", "c"} and pick("union") == {"b", "c"}
    with pytest.raises(ValueError):
        pick("x")
    rows = spark.createDataFrame([("street", "t", [], ["n"], "c"), ("mars", "t", ["x"], ["n"], "c"), ("street", "t", ["x"], ["n"], "c")], "scene string, indoor_outdoor string, terms array<string>, nodes array<string>, caption string")
    out = assembly.staged(rows, ["street"]).collect()
    assert [(r.nodes, r.caption, r.calls) for r in out] == [(None, "c", 4), (None, None, 2), (["n"], "c", 5)]
    payload_ = spark.createDataFrame([("k", '{"acoustic_semantics": {"nodes": [{"name": "Bark", "evidence": "e", "inference_type": "x"}, {"id": "/m/1", "evidence": "again"}, {"id": "/m/2"}, 7]}}')], "k string, j string").select("k", F.parse_json("j").alias("payload"))
    nodes = spark.createDataFrame([("/m/1", "Bark"), ("/m/2", "Meow")], "id string, name string")
    assert [(r.id, r.inference_type, r.confidence) for r in assembly.legacy_acoustic(payload_, nodes, "k").collect()] == [("/m/1", "uncertain", 0.5)]
    scene = spark.createDataFrame([("k", "street", None)], "k string, label string, indoor_outdoor string")
    ents = spark.createDataFrame([("k", "e1", "dog", "animal", 1, 0.5)], "k string, id string, label string, category string, count_estimate bigint, confidence double")
    none = spark.createDataFrame([], "k string, subject_id string, verb string, relation string, object_id string, confidence double")
    core = assembly.legacy_core(scene, ents, none, none, "k").first().core
    assert '"A street scene."' in core and '"unknown"' in core
    assert spark.range(1).select(assembly.clip_score(F.lit(-0.2)).alias("a"), assembly.clip_score(F.lit(0.25)).alias("b")).first()[:] == (0.0, 25.0)
    with pytest.raises(ValueError, match="spice"):
        assembly.requested(spark.range(1), ["spice"], {"cider": ["CIDEr"]}, ["id"])


def test_scene_relevance(spark):
    from scenarium.operators import records

    rows = spark.createDataFrame([("a", "car"), ("a", "dog"), ("b", "car"), (None, "car")], "k string, label string")
    groups = spark.createDataFrame([("a", "x"), ("a", "y"), ("a", "x"), ("b", None)], "k string, group string")
    got = [(r.k, r.label, r.scene_relevance) for r in records.scene_relevance(rows, groups, {"x": {"car": 0.5}, "y": {"car": 0.9}}, "k").collect()]
    assert sorted(got, key=str) == sorted([("a", "car", 0.9), ("a", "dog", 0.0), ("b", "car", 0.0), (None, "car", 0.0)], key=str)


def test_means_skip_what_does_not_apply(spark):
    from scenarium.operators import records

    rows = spark.createDataFrame([("a", "n/a"), ("a", "0.5"), ("a", ""), ("b", "n/a"), ("b", None)], "k string, x string")
    assert {r.k: (r.n, r.x) for r in records.means(rows, ["k"], ["x"]).collect()} == {"a": (3, 0.5), "b": (2, None)}
