"""Readers, writers and streams on small files."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from scenarium.sources import files as S
from scenarium.streaming import predictions as P


def test_manifest_and_bodies(spark, tmp_path):
    (tmp_path / "json").mkdir()
    (tmp_path / "json" / "007.json").write_text('{"a": 1}')
    (tmp_path / "m.csv").write_text(f"image_id,json_path,detector,scene_model,captioner\n007,{tmp_path}/json/007.json,d,s,c\n8,/none,d,s,c\n")
    rows = S.manifest(spark, str(tmp_path / "m.csv"))
    got = {r.image_id: r.body for r in S.bodies_of(rows, S.whole_texts(spark, str(tmp_path / "json"))).collect()}
    assert got == {"007": '{"a": 1}', "8": None}
    (tmp_path / "bad.csv").write_text("image_id\n1\n")
    with pytest.raises(ValueError, match="json_path"):
        S.manifest(spark, str(tmp_path / "bad.csv"))


def test_references(spark):
    rows = spark.createDataFrame([("1", "a|b||a"), ("1", "c"), ("2", "")], "image_id string, objects string").withColumn("o", F.monotonically_increasing_id())
    got = {r.image_id: r.objects for r in S.object_sets(rows).collect()}
    assert got == {"1": ["c"], "2": []}
    rel = spark.createDataFrame([("1", "a::on::b|x::y|a::on::b")], "image_id string, relationships string")
    assert [tuple(t) for t in S.relation_sets(rel).first().triples] == [("a", "on", "b")]
    caps = spark.createDataFrame([("1", "y"), ("1", "x")], "image_id string, reference_caption string")
    assert [(r.ref, r.text) for r in S.caption_references(caps).orderBy("ref").collect()] == [(0, "y"), (1, "x")]  # in the order of rows


def test_text_files(spark, tmp_path):
    (tmp_path / "alias.txt").write_text("person,Man, ,woman\nhuman,man\n,\n")
    pairs = {r.alias: r.canonical for r in S.alias_pairs(S.numbered_lines(spark, str(tmp_path / "alias.txt"))).collect()}
    assert pairs == {"person": "person", "man": "human", "woman": "person", "human": "human"}
    (tmp_path / "cats.txt").write_text("/a/airfield 0\n/c/church/outdoor 1\nbad\n")
    assert [(r.number, r.label) for r in S.scene_categories(S.numbered_lines(spark, str(tmp_path / "cats.txt"))).orderBy("number").collect()] == [(0, "airfield"), (1, "church outdoor")]
    (tmp_path / "run.jsonl").write_text('{"image_id": "1", "json_path": "a"}\n{"image_id": "1", "json_path": "b"}\n\n')
    assert S.run_index(spark, str(tmp_path / "run.jsonl")).first().json_path == "b"


def test_dumps(spark, tmp_path):
    wanted = spark.createDataFrame([("1",), ("2",)], "image_id string")
    m = F.create_map(F.lit("man"), F.lit("person"))
    def dump(name, rows, schema):
        (tmp_path / name).write_text(json.dumps(rows))
        return S.json_array(spark, str(tmp_path / name), schema)

    reg = dump("r.json", [{"id": 1, "regions": [{"phrase": " a "}, {"phrase": ""}]}, {"image_id": 3, "regions": [{"phrase": "z"}]}], S.REGIONS)
    assert [tuple(r) for r in S.region_references(reg, wanted).collect()] == [("1", "a")]
    obj = dump("o.json", [{"image_id": 1, "objects": [{"names": ["Man", "dog"]}, {"names": ["person"]}]}, {"image_id": 2, "objects": []}], S.OBJECTS)
    assert {r.image_id: r.objects for r in S.object_references(obj, wanted, m).collect()} == {"1": "dog|person", "2": ""}
    rel = dump("s.json", [{"image_id": 1, "relationships": [{"predicate": "ON", "subject": {"names": ["man", "boy"]}, "object": {"names": ["road"]}}]}, {"image_id": 2, "relationships": []}], S.RELATIONSHIPS)
    assert {r.image_id: r.relationships for r in S.relationship_references(rel, wanted, m, m).collect()} == {"1": "boy::on::road|person::on::road", "2": ""}
    onto = dump("onto.json", [{"id": "/m/1", "name": "x", "child_ids": ["/m/2"]}], S.ONTOLOGY)
    assert onto.first().child_ids == ["/m/2"]


def test_images(spark, tmp_path):
    for name in ("b.jpg", "a.jpg", "c.png", "c.jpeg", "d.txt"):
        (tmp_path / name).write_bytes(b"x")
    assert [r.path.rsplit("/", 1)[1] for r in S.images(spark, str(tmp_path), limit=1).collect()] == ["a.jpg"]
    found = S.image_paths(spark.createDataFrame([("c",), ("z",)], "image_id string"), S.images(spark, str(tmp_path), "*.{jpg,jpeg,png}"))
    assert {r.image_id: r.path and r.path.rsplit("/", 1)[1] for r in found.collect()} == {"c": "c.jpeg", "z": None}


def test_sinks(spark, tmp_path):
    with pytest.raises(ValueError, match="no rows"):
        S.write_csv(spark.range(0), str(tmp_path / "x"))
    S.write_csv(spark.range(2).withColumn("a", F.lit("q,")), str(tmp_path / "x"), ["a", "id"])
    assert S.csv_text(spark, str(tmp_path / "x")).columns == ["a", "id"]
    assert S.sorted_union(spark.range(1).withColumn("z", F.lit(1)), spark.range(1).withColumn("b", F.lit(1))).columns == ["b", "id", "z"]
    rows = spark.createDataFrame([("1", "raw", "{}", "c", None), ("2", "raw", None, None, "bad")], "image_id string, raw string, json string, caption string, error string")
    S.write_outputs(rows, str(tmp_path / "run"))
    assert spark.read.parquet(str(tmp_path / "run/json")).count() == 1 and spark.read.json(str(tmp_path / "run/failed")).first().raw_path == "raw/2"
    got = {(r.status, r.image_id): r.error for r in S.retry_report(rows, 2).collect()}
    assert json.loads(got.pop(("total", None))) == {"total_images": 2, "succeeded": 1, "failed": 1, "max_retries": 2} and got == {("succeeded", "1"): None, ("failed", "2"): "bad"}
    assert json.loads(S.retry_report(rows.limit(0), 2).first().error)["total_images"] == 0


def test_stream(spark, tmp_path):
    source, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    rows = [(i, "x", '{"core": {"nodes": []}}' if i % 2 else "{", f"2024-01-0{1 + i % 3} 00:00:00", f"2024-01-0{1 + i % 3} 01:00:00") for i in range(9)]
    df = spark.createDataFrame(rows + rows[:2], "nested_id bigint, image_id string, body string, written_at string, ingested_at string")
    df.withColumns({c: F.col(c).cast("timestamp") for c in ("written_at", "ingested_at")}).write.parquet(source)
    stream = P.windowed_counts(P.kinds(P.delivered_once(P.arrivals(spark, source), "nested_id", "ingested_at")), "ingested_at", late=None)
    query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert query.exception() is None
    assert set(spark.read.parquet(out).columns) >= {"start", "kind", "n"}
    # Windows stay open until the watermark passes them; without that wait the counts are those of the batch.
    batch = P.kinds(spark.read.parquet(source).dropDuplicates(["nested_id"])).groupBy("kind").count()
    assert {r["kind"]: r["count"] for r in batch.collect()} == {"audioset": 4}
