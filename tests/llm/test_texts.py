"""Cut text, encoding, packing and languages."""

from __future__ import annotations

import random

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from scenarium.llm import bpe, language, packing, truncation

FOLDER = "/root/testdata/sf0.01"


# ---- encoding


@pytest.fixture(scope="module")
def public():
    t = Tokenizer.from_file(f"{bpe.FOLDER}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    return lambda texts: [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


def test_encode_documents(spark, public):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    rows = docs.select("doc_id", "text").collect()
    want = dict(zip([r.doc_id for r in rows], public([r.text or "" for r in rows])))
    assert {r.doc_id: r.ids for r in bpe.encode(docs).collect()} == want
    assert {r.doc_id: r.size for r in bpe.sizes(docs).collect()} == {k: len(v) for k, v in want.items()}


def test_encode_odd_texts(public):
    rng = random.Random(3)
    parts = [" ", "  ", "\n", "\t", "'", "'s", "'re", "é", "日本", "。", "…", "😀", "👩‍🔧", " ", "　", " ", "́", "a", "1", "Ⅷ", "the", " the", "!", '"', ".", "<|endoftext|>", "_", "\x85", "\x1c", "ё", "ع", "न", "​", "﻿"]
    texts = ["", " ", "a" * 5000, "日" * 3000, "x y " * 3000, *("".join(rng.choice(parts) for _ in range(rng.randrange(1, 25))) for _ in range(5000))]
    enc = bpe.encoder()
    want = public(texts)
    assert [enc.encode(t) for t in texts] == want
    assert all(enc.whole.decode(ids) == t for ids, t in zip(want, texts))


def test_forced_pairs():
    enc = bpe.encoder()
    for token in list(enc.ranks)[::97]:
        b = np.frombuffer(token, dtype=np.uint8).astype(int)
        assert not enc.forced[b[:-1] << 8 | b[1:]].any()
    assert len(enc.cuts(np.frombuffer(("word " * 400).encode(), dtype=np.uint8))) == 400


def test_encode_empty(spark):
    df = spark.createDataFrame([(1, None, 5), (2, "", 5), (2, "a", 5), (2, "a", 5)], "doc_id bigint, text string, ids int")
    assert sorted((r.doc_id, r.ids) for r in bpe.encode(df).collect()) == [(1, []), (2, []), (2, [64]), (2, [64])]
    assert bpe.encode(df.limit(0)).count() == 0


# ---- packing


@pytest.mark.parametrize(("windows", "fan_in", "parts"), [(3, 2, 7), (64, 32, 2)])
def test_pack(spark, windows, fan_in, parts):
    rng = random.Random(1)
    sizes = [(i, rng.choice([0, 1, 5, 99, 100, 101, 250, rng.randrange(1, 100), None])) for i in range(600)] + [(600, 100_000)]
    df = spark.createDataFrame([(*s, "x") for s in sizes], "doc_id bigint, size bigint, container string").repartition(parts)
    rows = packing.pack(df, capacity=100, windows=windows, fan_in=fan_in).collect()
    fill, whole = {}, {}
    for r in rows:
        fill[r.container] = fill.get(r.container, 0) + r.size
        whole.setdefault(r.doc_id, []).append((r.start, r.size))
    assert max(fill.values()) <= 100
    want = {k: s for k, s in sizes if s}
    assert whole.keys() == want.keys()
    for k, pieces in whole.items():
        pieces.sort()
        assert sum(s for _, s in pieces) == want[k] and len(pieces) == -(-want[k] // 100)
        assert all(a[0] + a[1] == b[0] for a, b in zip(pieces, pieces[1:])) and pieces[0][0] == 0
    report = packing.fill_report(spark.createDataFrame(rows), 100).first()
    assert report.containers == len(fill) and report.least <= report.containers <= report.least * 1.1 + 2
    assert packing.pack(df.limit(0)).count() == 0


def test_windows_are_best_fit():
    w = packing.Windows(10, 2)
    assert [w.place(s)[0] for s in (6, 7, 3, 4)] == [0, 1, 1, 0]
    w = packing.Windows(10, 2)
    w.place(6), w.place(7)
    assert w.place(5) == (2, 1)  # none fits: the fullest goes


# ---- cut text


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ('{"a": "}"}', 10), ('{"a": [1, {"b": "\\""}]} x', 23), ('{"a": "x', None), ('{"a": "\\', None), ("{", None), ('{"a": 1,}', 9),
    ],
)
def test_json_end(text, want):
    assert truncation.json_end(text, 0) == want


def test_copies_are_exact(spark):
    """Far more texts than there were buckets: none of them is taken for another's copy."""
    rows = spark.range(300_000).selectExpr("'caption' field", "id record_id", "'s' source", "'caption' kind", "concat('Text ', id) text", "false open", "9L length", "0L most", "id same")
    assert truncation.copy_counts(rows).count() == 0
    values = spark.createDataFrame([("caption", i, "s", f" A dog{'' if i < 5 else i}\n", None) for i in [*range(8), 6, 6, 6]], "field string, record_id bigint, source string, text string, most bigint")
    units = truncation.units(values)
    assert [r.n for r in truncation.copy_counts(units).collect()] == [5]  # a repeated delivery is no copy
    words = {r.key: tuple(r)[1:] for r in truncation.word_counts(units).collect()}
    of = lambda w: words.get(truncation._key(w))
    assert of("a") == (0, 0, 11, 0, 0) and of("dog") == (0, 5, 0, 0, 0) and of("dog7") is None and of("cat") is None
    assert truncation.word_counts(units.limit(0)).count() == 0


def test_statistics_join(spark):
    """Joined statistics reach the units that have their keys, and no others; without keys nothing is lost."""
    values = spark.createDataFrame([("caption", i, "s", f"A dog barks{'.' if i else ''}", None) for i in range(12)] + [("raw", 99, "s", '{"a": 1}', 50)], "field string, record_id bigint, source string, text string, most bigint")
    rows = truncation.units(values)
    told = truncation.informed(rows.withColumn("own", F.lit(1).cast("bigint")), truncation.word_counts(rows), truncation.copy_counts(rows))
    got = {r.record_id: r for r in told.collect()}
    assert len(got) == 13 and (got[0].bare, got[0].stop, got[0].ended, got[0].unended, got[0].others) == (1, 11, 11, 1, 0)
    assert (got[5].others, got[5].closed, got[99].seen, got[99].others, got[99].closed) == (10, True, 0, 0, False)


def test_sample_is_taken_by_threshold(spark):
    """Some of each kind, whatever its share; cut ones are made of no others."""
    values = spark.createDataFrame([("caption", i, "s", f"A dog number {i} barks at the gate.", None) for i in range(2000)] + [("raw", i, "s", f"prose {i} without objects", 9) for i in range(30)], "field string, record_id bigint, source string, text string, most bigint")
    made = truncation.examples(truncation.units(values), 200).collect()
    whole = [r for r in made if r.y == 0]
    assert 130 < sum(r.kind == "caption" for r in whole) < 270 and sum(r.kind == "prose" for r in whole) == 30
    assert {r.unit for r in made if r.y == 1} <= {r.unit for r in whole} and all(r.text.endswith(".") for r in whole if r.kind == "caption")
    assert truncation.examples(truncation.units(values.limit(0))).count() == 0


def test_units():
    raw = '=== STAGE 1: a ===\nThe {x} is.\n```json\n{"caption": "One \\u00e9. Two"}}\n```\n\n=== STAGE 2: b ===\n{"core": {"a": 1\n\n'
    got = [list(truncation.units_of_answer(a)) for a in truncation.answers(raw)]
    assert [(k, o) for k, _, o in got[0]] == [("json", False), ("said", False)] and got[0][1][1] == "One é. Two"
    assert [(k, o) for k, _, o in got[1]] == [("json", True)]
    assert [k for k, _, _ in truncation.units_of_answer("No objects")] == ["prose"]
    assert truncation.answers(" \n") == []
    assert truncation.unescaped("a\\u00e9\\n\\u30") == "aé\n\\u30"


def test_cut_records(spark):
    """Held-out accuracy: whole captions, and others cut at random places that the model hasn't seen."""
    rng = random.Random(9)
    table = pq.read_table(f"{FOLDER}/core_preds.parquet", columns=["pred_id", "captioner", "caption"]).to_pylist()
    seen: dict = {}
    for r in table:
        if r["caption"] and r["caption"].rstrip().endswith(".") and r["caption"].startswith("The image") and len(r["caption"]) > 40 and not r["caption"].rstrip().endswith("..."):
            seen.setdefault(r["pred_id"], r["caption"])
    rows, cut = [], set()
    for n, (k, text) in enumerate(seen.items()):
        if n % 12 == 0:
            at = rng.randrange(len(text) // 2, len(text.rstrip()) - 3)
            if text[:at].rstrip().endswith("."):
                continue
            cut.add(k)
            text = text[:at] + rng.choice(["", "…"])
        rows.append(("caption", k, "s", text, None))
    rows += [("caption", -1, "s", None, None), ("caption", -2, "s", "  ", None)]
    out = truncation.scored(spark.createDataFrame(rows, "field string, record_id bigint, source string, text string, most bigint"))
    got = {r.record_id for r in truncation.cut_records(out).collect()}
    # Some of the stored captions taken as whole are cut themselves, so precision is a lower bound.
    assert len(got & cut) >= 0.9 * len(cut) and len(got & cut) >= 0.8 * len(got)
    rate = truncation.cut_rates(out).first()
    assert rate.n == len(rows) - 2 and rate.n_cut == len(got)


def test_cut_empty(spark):
    none = spark.createDataFrame([("caption", 1, "s", None, None)], "field string, record_id bigint, source string, text string, most bigint")
    assert truncation.cut_records(truncation.scored(none)).count() == 0


# ---- languages

WORDS = {
    "en": "the dog and a man walk in the old street near this river while people look at them",
    "es": "el perro y un hombre caminan por la calle vieja cerca del rio mientras la gente los mira",
    "de": "der hund und ein mann gehen auf der alten strasse neben dem fluss und die leute sehen zu",
}


def sentence(rng, lang, n=9):
    return " ".join(rng.choice(WORDS[lang].split()) for _ in range(n)).capitalize() + "."


def docs(spark, n=240):
    rng = random.Random(6)
    rows, truth = [], {}
    for i in range(n):
        lang = rng.choice(list(WORDS))
        text = " ".join(sentence(rng, lang) for _ in range(4))
        label = rng.choice([lang, lang.upper(), f"{lang}-XX", lang, lang, lang])
        if i % 10 == 0:
            label = rng.choice([x for x in WORDS if x != lang])
            truth[i] = {("wrong", lang)}
        elif i % 10 == 1:
            label = rng.choice([None, "", "und", "??"])
            truth[i] = {("missing", lang)}
        elif i % 10 == 2:
            other = rng.choice([x for x in WORDS if x != lang])
            text += "\n" + " ".join(sentence(rng, other) for _ in range(3))
            truth[i] = {("mixed", lang), ("mixed", other)}
        elif i % 10 == 3:
            text += ' {"a": 1} x|y|z outputs/run/1.json'
        rows.append((i, text, label, 1))
    rows += [(n, None, None, 1), (n + 1, "", None, 1), (n + 2, "123 456 | /a/b.json", None, 1), (n + 3, "x" * 500, None, 1)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, letters int"), truth


def test_languages(spark):
    df, truth = docs(spark)
    models = language.learn(df)
    assert models.languages == ["de", "en", "es"]
    found = language.documents(df, models)
    got: dict = {}
    for r in language.issues(found).collect():
        got.setdefault(r.doc_id, set()).add((r.issue, r.lang))
    assert got == truth
    rows = {r.doc_id: r for r in df.collect()}
    for s in language.segments(found).collect():
        assert 0 <= s.start < s.end <= len(rows[s.doc_id].text) and 0 < s.confidence <= 1
    assert language.learn(df.limit(0)) is None
    assert language.documents(df.limit(0), models).count() == 0
    assert found.count() == df.count()
    counts = {r.code: (r.n, r.trained) for r in language.label_counts(df.unionByName(spark.createDataFrame([(999, "x", "sv", 1)], df.schema))).collect()}
    assert counts["sv"] == (1, False) and counts["en"][1]


def test_short_texts(spark):
    """A text of short pieces is judged as one; what says too little is of no language, at any place."""
    df, _ = docs(spark)
    models = language.learn(df)
    asked = spark.createDataFrame([(1, "The. Dog. Man. Walk. Street.", None), (2, "Der. Hund. Mann. Fluss. Strasse.", None), (3, "Q.", None), (4, "", None), (5, None, None), (5, None, None)], "doc_id bigint, text string, lang string")
    got = {r.doc_id: [x.lang for x in r.languages] for r in language.documents(asked, models).collect()}
    assert got == {1: ["en"], 2: ["de"], 3: [], 4: [], 5: []}


@pytest.mark.parametrize(("label", "want"), [(" EN", "en"), ("en-US", "en"), ("fr_ca", "fr"), ("spa", "es"), ("German", "de"), ("und", None), ("", None), (None, None), ("??", None), ("n/a", None), ("mul", None), ("sv", "sv"), ("unknown", None)])
def test_labels(spark, label, want):
    assert spark.range(1).select(language.label_code(F.lit(label).cast("string")).alias("x")).first().x == want


def test_models_are_distributions():
    models = language.train({"a": [" abab ", " abba "], "b": [" bbb "]})
    letters = sorted(set(" ab"))
    for k in range(2):
        for context in ("", " a", " ab", " abb", " z"):
            score = lambda t: -models.entropies([t])[0, k] * len(t)  # noqa: B023, E731
            total = sum(np.exp(score(context + c) - (score(context) if context else 0.0)) for c in [*letters, "q"])
            assert total == pytest.approx(1.0, abs=1e-5)


def said(text):
    clean = language.blanked([text])[0]
    assert len(clean) == len(text)
    return [" ".join(s.split()) for *_, s, _ in language.sentences(clean) if any(c.isalpha() for c in s)]


def test_noise_is_no_sentence():
    assert said('Eins zwei. {"a": "b c"} (x, y) Drei vier! a b|c d|e Fünf sechs. /m/zz01 /m/zz02')[:2] == ["Eins zwei.", "Drei vier!"]
    assert said("二つです。三つ") == ["二つです。", "三つ"]
    assert said("One. (hay meadow, price board) Two three") == ["One.", "Two three"] and said("[PAD] <|end|> a/b.json x=1 12.5") == []
    assert said("`` ( [ { un[closed. ((( :) ok") == ["`` ( [ { un[closed.", "((( :) ok"]


@pytest.mark.parametrize("n", [1, 4, 40, 4000])
def test_noise_of_any_length(n):
    """What a form holds decides, not how long it is."""
    clause = " and ".join(["nobody saw it"] * n)
    assert said(f"One ({clause}) two.") == [f"One ({clause}) two."]
    labels = ", ".join(["hay meadow", "dog"] * n)
    assert said(f"One ({labels}) two.") == ["One two."] and said(labels.replace(", ", "|")) == []
    data = '{"a": [' + ", ".join(['{"b": "x } y", "c": 1}'] * n) + "]}"
    assert said(f"One {data} two.") == ["One two."]
    assert said("<" + "t" * n + "> one.") == ["one."] and said("a/" * n + " one.") == ["one."]


def test_many_open_brackets():
    """One pass, however many brackets are never closed."""
    assert len(said("([{" * 100_000 + " word.")) == 1
