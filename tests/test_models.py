"""Models behind their interfaces, a chat server over HTTP, and the command line."""

from __future__ import annotations

import json
from http.server import BaseHTTPRequestHandler, HTTPServer
from threading import Thread

import numpy as np
import pytest

from scenarium import cli
from scenarium.operators import models, providers

IMAGES = "k string, content binary, width double, height double"


@pytest.fixture(scope="module")
def server():
    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):  # noqa: N802
            asked = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            text = asked["messages"][0]["content"][0]["text"]
            code = 500 if text == "fail" else 200
            image = any(p["type"] == "image_url" and p["image_url"]["url"].startswith("data:image/png;base64,") for p in asked["messages"][0]["content"])
            said = {"choices": []} if text == "odd" else {"choices": [{"message": {"content": f' {{"core": {{"caption": "{text} {image}"}}}} '}}]}
            body = b"bad" if code == 500 else json.dumps(said).encode()
            self.send_response(code)
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *args):
            pass

    http = HTTPServer(("127.0.0.1", 0), Handler)
    Thread(target=http.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{http.server_port}"
    http.shutdown()


def test_chat_server(spark, server, tmp_path):
    (tmp_path / "a.png").write_bytes(b"x")
    model = models.ChatServer(server, timeout=5)
    assert model.ask("hi") == '{"core": {"caption": "hi False"}}' and "True" in model.ask("hi", str(tmp_path / "a.png"))
    with pytest.raises(models.Refused, match="500"):
        model.ask("fail")
    with pytest.raises(models.Malformed):
        model.ask("odd")
    with pytest.raises(models.Unreachable):
        models.ChatServer("http://127.0.0.1:9", timeout=1).ask("hi")
    rows = spark.createDataFrame([("1", "hi", ""), ("2", "fail", ""), ("3", None, None)], "k string, prompt string, image string")
    got = {r.k: r for r in providers.asked(rows, "k", model).collect()}
    assert got["1"].error is None and got["2"].answer is None and got["2"].error.startswith("Refused") and got["3"].error is None


def test_scenes(spark):
    best, p = models.top_scenes(np.array([[0.0, 2.0, 1.0, 2.0]]), 3)
    assert best.tolist() == [[1, 3, 2]] and p[0, 0] == p[0, 1] > p[0, 2]

    def fails(images):
        if b"bad" in images:
            raise ValueError("no image")
        return models.HashedScores(3)(images)

    rows = spark.createDataFrame([("a", b"1", 1.0, 1.0), ("b", b"bad", 1.0, 1.0), ("c", b"", 1.0, 1.0)], IMAGES)
    got = [tuple(r) for r in models.classified_scenes(rows, "k", fails, ["x", "y", "z"], ["y"], 2).collect()]
    assert sum(r[5] is None for r in got) == 4 and [r for r in got if r[5]] == [("b", None, None, None, None, "ValueError: no image")]
    assert all((r[3] == "indoor") == (r[2] == "y") for r in got if r[2]) and models.classified_scenes(rows.limit(0), "k", fails, [], []).count() == 0


def test_detectors(spark):
    rows = spark.createDataFrame([("a", b"12", 100.0, 50.0), ("b", b"", 10.0, 10.0)], IMAGES)

    def fixed(image, prompt, box, text):
        if prompt == "fail":
            raise RuntimeError("x")
        return [("dog", 0.9, 0.5, 0.5, 0.2, 0.4)] if image else []

    got = [r for r in models.detected(rows, "k", [("one", "dog", 0.3, 0.2), ("two", "fail", 0.3, 0.2), ("three", "cat", 0.3, 0.2)], fixed, "s").collect()]
    good = [r for r in got if r.k == "a" and r.error is None]
    assert [(r.ord, r.batch, r.x1, r.y1, r.x2, r.y2) for r in good] == [(0, "one", 40.0, 15.0, 60.0, 35.0), (1, "three", 40.0, 15.0, 60.0, 35.0)]
    assert {(r.k, r.batch) for r in got if r.error} == {("a", "two"), ("b", "two")} and all(r.source == "s" for r in got)
    assert models.detected(rows, "k", [("one", "dog", 0.3, 0.2)], models.no_boxes, "s").count() == 0
    assert models.detected(rows, "k", [("one", "dog, cat, bird", 0.0, 0.2)], models.hashed_boxes, "s").count() == 6
    seen = models.interactions(rows, "k", models.Always([("hold", 0.5, (0, 0, 1, 1), (1, 1, 2, 2))])).collect()
    assert len(seen) == 2 and seen[0].o.x2 == 2.0 and models.interactions(rows, "k", models.no_interactions).count() == 0


def test_command_line(spark, server, tmp_path, capsys):
    assert cli.main(["list"]) == 0 and "set_prf" in capsys.readouterr().out
    assert cli.main(["query", "nothing", "--data", "x", "--out", "y"]) == 2
    with pytest.raises(SystemExit):
        cli.main(["report", "unknown", "--data", "x", "--out", "y"])
    assert cli.main(["query", "count_bins", "--data", "/root/testdata/sf0.001", "--out", str(tmp_path / "bins")]) == 0
    assert spark.read.parquet(str(tmp_path / "bins")).count() > 0
    (tmp_path / "m.csv").write_text("image_id,prompt\n1,hi\n2,fail\n3,\n")
    assert cli.main(["ask", "--manifest", str(tmp_path / "m.csv"), "--out", str(tmp_path / "run"), "--server", server, "--retries", "1"]) == 0
    assert {r.image_id: r.caption for r in spark.read.parquet(str(tmp_path / "run/captions")).collect()} == {"1": "hi False", "3": " False"}
    failed = spark.read.json(str(tmp_path / "run/failed")).collect()
    assert [r.image_id for r in failed] == ["2"] and "500" in failed[0].error
