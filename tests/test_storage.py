from __future__ import annotations

from pathlib import Path

from scenarium import storage


def test_scratch(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(storage, "shared_folder", lambda _: f"file://{tmp_path}")
    scratch = storage.Scratch(spark, "x")
    a = scratch.write(spark.range(3), "a")
    empty = scratch.write(spark.range(0), "b")
    assert a.count() == 3 and empty.count() == 0 and empty.columns == ["id"]
    scratch.drop(empty)
    assert len(list(Path(scratch.root.removeprefix("file://")).iterdir())) == 1
    storage.sweep(spark)
    assert not Path(scratch.root.removeprefix("file://")).exists()


def test_folder_without_setting(spark, monkeypatch):
    class Conf:
        def get(self, *_):
            return None

    class Session:
        conf = Conf()
        sparkContext = spark.sparkContext

    first = storage.shared_folder(Session())
    assert first.startswith("file://") and storage.shared_folder(Session()) == first
