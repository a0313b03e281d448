"""Queries over their whole tables, where the query with SQL is of a part."""

from __future__ import annotations

import pytest

from scenarium.plans import evaluation


@pytest.fixture
def folder(spark, tmp_path):
    def put(name, rows, schema):
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")

    boxes = [(1, 1, [0.0, 0.0, 10.0, 10.0]), (2, 3, [0.0, 0.0, 10.0, 9.0]), (3, 2, [0.0, 0.0, 10.0, 5.0]), (4, None, [50.0, 50.0, 60.0, 60.0]), (5, 4, [50.0, 50.0, 60.0, 61.0]), (6, 6, [90.0, 90.0, 95.0, 95.0])]
    put("groundings", [(r, 7, o, "n1", "dog", b, "det", 0.5) for r, o, b in boxes] + [(1, 7, 1, "n1", "dog", boxes[0][2], "det", 0.5)], "row_id bigint, pred_id bigint, ord bigint, node_id string, visual_label_raw string, bbox array<double>, source string, detector_confidence double")
    onto = [("base", "b", "Base", []), ("o", "r", "Root", ["x", "y"]), ("o", "x", "Dog, Hound", ["z"]), ("o", "y", "Cat", []), ("o", "z", "Pup", ["z2"]), ("p", "q", "Cat", ["gone"])]
    put("onto_nodes", [(*r, []) for r in onto], "ontology_id string, id string, name string, child_ids array<string>, restrictions array<string>")
    put("core_preds", [(1, "i", "cap_alder", "a dog runs home"), (2, "i", "cap_cedar", "a dog runs here"), (3, "i", "cap_x", "the cat sits on it"), (4, "i", "cap_x", "a dog runs home"), (5, "j", "cap_x", "alone it is"), (1, "i", "cap_alder", "a dog runs home")], "pred_id bigint, image_id string, captioner string, caption string")
    put("core_nodes", [(1, "n1", "x"), (1, "n2", "z"), (2, "n1", "y"), (3, "n1", "z"), (4, "n1", "q"), (5, "n1", "b")], "pred_id bigint, node_id string, audioset_id string")
    return str(tmp_path)


def test_all_ontologies(spark, folder):
    assert {tuple(r) for r in evaluation.ontology_names_all(spark, folder).collect()} >= {("cat", "q"), ("pup", "z"), ("hound", "x"), ("base", "b")}
    got = {(r.node, r.anc): r.near for r in evaluation.ontology_distances_all(spark, folder).collect()}
    assert got == {("b", "b"): 0, ("r", "r"): 0, ("x", "x"): 0, ("y", "y"): 0, ("z", "z"): 0, ("q", "q"): 0, ("x", "r"): 1, ("y", "r"): 1, ("z", "x"): 1, ("z", "r"): 2}
    # x and y share r two steps apart, z and y three: (1/3 + 1/4 + 1/3) / 3
    assert [tuple(r) for r in evaluation.best_similarity_all(spark, folder).select("image_id", "distance_similarity").collect()] == [("i", 0.305556)]


def test_grounding_matches_all(spark, folder):
    got = {(r.box_id, r.match_id) for r in evaluation.grounding_matches_all(spark, folder).collect()}
    assert got == {(1, 2), (2, 1), (3, 2), (4, 5), (5, 4)}


def test_all_captioners(spark, folder):
    rows = evaluation.hierarchical_prf_all(spark, folder).collect()
    got = {(r.pred_id, r.ref_captioner): (r.node_precision, r.node_recall) for r in rows}
    assert len(rows) == len(got) and got == {
        (1, "cap_cedar"): (0, 0), (1, "cap_x"): (0.5, 0.5), (2, "cap_alder"): (0, 0), (2, "cap_x"): (0, 0), (3, "cap_alder"): (1, 0.5), (3, "cap_cedar"): (0, 0),
        (4, "cap_alder"): (0, 0), (4, "cap_cedar"): (0, 0), (5, None): (None, None),
    }


def test_all_detectors(spark, tmp_path):
    det = [(1, "i", "a", 0.9), (2, "i", "a", 0.1), (3, "i", "b", 0.9), (4, "i", "c", None), (4, "i", "c", None), (5, "i", None, 0.9), (6, "j", "a", 0.9)]
    spark.createDataFrame(det, "det_id bigint, image_id string, source string, confidence double").write.parquet(f"{tmp_path}/detections.parquet")
    got = {(r.source_before, r.source_after): (r.n_raw_before, r.n_raw_after, r.filtered_delta) for r in evaluation.detection_differences_all(spark, str(tmp_path)).collect()}
    assert got == {("a", "b"): (2, 1, 0), ("a", "c"): (2, 1, -1), ("b", "c"): (1, 1, -1)}
