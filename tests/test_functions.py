"""Golden values of expressions."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from scenarium.functions import geometry as G
from scenarium.functions import text as T
from scenarium.operators import rules
from scenarium.operators.geometry import entity_geometry, global_geometry


def value(spark, c):
    return spark.range(1).select(c.alias("v")).first().v


def arr(*xs):
    return F.array(*[F.lit(x) for x in xs]).cast("array<string>")


@pytest.mark.parametrize(
    ("made", "want"),
    [
        (lambda: T.ascii_folded(F.lit("  Traffic_Light-2! ")), "traffic light 2"),
        (lambda: T.scene_label(F.lit("Church/Outdoor_x")), "church outdoor x"),
        (lambda: T.normalised(F.lit(" A_b ")), "a b"),
        (lambda: T.normalised(F.lit(None).cast("string")), None),
        (lambda: T.label_or(F.lit(""), "none"), "none"),
        (lambda: T.embedding_label(F.lit("A-b/c_d  e")), "a b c d e"),
        (lambda: T.singular_phrase(F.lit("buses glasses churches babies cars cactus taxis gas bus leaves waves")), "bus glass church baby car cactus taxi gas bus leaf wave"),
        (lambda: T.segments(F.lit("a Computer, keyboard.")), "a computer | keyboard | "),
        (lambda: T.without_scene(F.lit("an outdoor street scene"), F.lit("street/x")), "an outdoor  |  scene"),
        (lambda: T.without_scene(F.lit("abc"), F.lit("")), "abc"),
        (lambda: T.prompt_labels(F.lit("a dog. The cat; an owl, dog")), ["dog", "cat", "owl"]),
        (lambda: T.english_list(arr("a", "b", "c")), "a, b, and c"),
        (lambda: T.english_list(arr("a", "b", "c"), oxford=False), "a, b and c"),
        (lambda: T.english_list(arr()), ""),
        (lambda: T.with_article(F.lit("owl"), F.lit(1)), "an owl"),
        (lambda: T.with_article(F.lit("dog"), F.lit(3)), "3 dogs"),
        (lambda: T.sound_phrase(F.lit("Walk, footsteps"), F.lit(None).cast("int")), "walk"),
        (lambda: T.finished_caption(arr(" a... ", "", "b")), "a. b."),
        (lambda: T.finished_caption(arr("")), "A visual scene."),
        (lambda: T.one_line_caption(F.lit('"x y"')), "x y."),
        (lambda: T.unit_confidence(F.lit("nan")), 0.0),
        (lambda: T.unit_confidence(F.lit("7")), 1.0),
        (lambda: T.unit_confidence(F.lit("x"), 0.5), 0.5),
        (lambda: T.data_url(F.lit(b"abc"), F.lit("png")), "data:image/png;base64,YWJj"),
        (lambda: T.count_bin(F.lit(4)), "group"),
        (lambda: rules.parsed(F.lit("man and food or eat")), [["man"], ["food", "eat"]]),
        (lambda: rules.parsed(F.lit("cow or bull or sheep (bovinae)")), [["cow", "bull", "sheep"]]),
        (lambda: rules.parsed(F.lit("street or avenue... (outside urban)")), [["street", "avenue"]]),
        (lambda: rules.parsed(F.lit("CD")), [["cd", "compact disc"]]),
    ],
)
def test_text(spark, made, want):
    assert value(spark, made()) == want


@pytest.mark.parametrize(
    ("path", "want"),
    [
        ("/x/grounding_dino_resnet50/7.json", ("grounding_dino", "resnet50", "template")),
        ("/x/runX/json/7.json", ("unknown", "runX", "template")),
        ("/captions_gemma/owlv2_a/7.json", ("owlv2", "a", "gemma")),
        ("7.json", ("unknown", "unknown", "template")),
    ],
)
def test_path(spark, path, want):
    assert tuple(value(spark, T.path_condition(F.lit(path)))) == want


def test_natural_order(spark):
    rows = spark.createDataFrame([("10",), ("9",), ("a",), ("08",)], "id string")
    assert [r.id for r in rows.orderBy(*T.natural_order(F.col("id"))).collect()] == ["08", "9", "10", "a"]


def test_geometry(spark):
    rows = spark.createDataFrame([("i", 0, "person", 50.0, 50.0, 200.0, 300.0, 0.95, "human"), ("i", 1, "horse", 200.0, 100.0, 400.0, 350.0, 0.88, "animal")], "image_id string, ord int, label string, x1 double, y1 double, x2 double, y2 double, confidence double, category string")
    out = entity_geometry(rows, F.lit(640.0), F.lit(480.0))
    a, b = out.orderBy("ord").collect()
    assert (a.relative_size, a.position_coarse, a.is_central) == ("medium", "left-middle", False)
    assert (b.relative_size, b.position_coarse, b.is_central) == ("large", "center-middle", True)
    assert a.salience_score == pytest.approx(0.7395703125) and b.salience_score == pytest.approx(0.8847604166)
    g = global_geometry(out).first()
    assert g.total_object_coverage == pytest.approx(0.284830729) and g.object_density_proxy == pytest.approx(0.1)
    assert g.category_counts == {"human": 1, "animal": 1}
    assert global_geometry(out.limit(0)).count() == 0
    box = lambda *v: G.Box(*(F.lit(float(x)) for x in v))
    assert value(spark, G.iou(box(0, 0, 10, 10), box(2, 0, 12, 10))) == pytest.approx(80 / 120)
    assert value(spark, G.iou(box(0, 0, 0, 0), box(0, 0, 0, 0))) == 0.0
    assert [value(spark, c) for c in G.clipped(box(700, -5, 10, 20), F.lit(640), F.lit(480))] == [10.0, 0.0, 640.0, 20.0]
    assert [value(spark, c) for c in G.Box.from_centre(*(F.lit(float(x)) for x in (5, 5, 4, 2)))] == [3.0, 4.0, 7.0, 6.0]
    assert [value(spark, c) for c in G.rescaled(box(1, 2, 3, 4), *(F.lit(float(x)) for x in (10, 10, 20, 30)))] == [2.0, 6.0, 6.0, 12.0]
