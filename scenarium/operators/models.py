"""Models as batched functions: a chat server, scene classifiers, detectors and interaction models, with stand-ins of each.

A model is a callable on a batch; Spark calls it once per Arrow batch (``mapInPandas``), so that a worker loads it once. Failures are
data: a batch that fails gives rows with an error. Stand-ins need no weights and are deterministic.
"""

from __future__ import annotations

import base64
import json
import mimetypes
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path
from typing import Protocol
from urllib import error, request

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class ModelError(RuntimeError):
    """A model gave no answer."""


class Unreachable(ModelError):
    """Its server can't be reached, or not in time."""


class Refused(ModelError):
    """Its server answered with an error."""


class Malformed(ModelError):
    """Its answer isn't what the protocol says."""


@dataclass
class ChatServer:
    """A model behind the public chat-completions protocol over HTTP: one request per prompt, the image (a path) as a data URL."""

    base_url: str
    model: str = "default"
    timeout: float = 600.0
    max_tokens: int = 1024

    def __call__(self, prompts: list[str], images: list[str]) -> list[str]:
        return [self.ask(p, i) for p, i in zip(prompts, images)]

    def ask(self, prompt: str, image: str = "") -> str:
        parts: list[dict] = [{"type": "text", "text": prompt}]
        if image:
            parts.append({"type": "image_url", "image_url": {"url": image_url(image)}})
        body = json.dumps({"model": self.model, "max_tokens": self.max_tokens, "messages": [{"role": "user", "content": parts}]}).encode()
        call = request.Request(f"{self.base_url.rstrip('/')}/v1/chat/completions", body, {"Content-Type": "application/json"})
        try:
            with request.urlopen(call, timeout=self.timeout) as answer:
                said = answer.read()
        except error.HTTPError as e:
            raise Refused(f"HTTP {e.code}: {e.read()[:500].decode('utf-8', 'replace')}") from e
        except OSError as e:  # no connection, no such host, too late
            raise Unreachable(f"{self.base_url}: {e}") from e
        try:
            return json.loads(said)["choices"][0]["message"]["content"].strip()
        except (ValueError, LookupError, TypeError, AttributeError) as e:
            raise Malformed(f"no message in {said[:200]!r}") from e


def image_url(path: str) -> str:
    kind = mimetypes.guess_type(path)[0] or "image/jpeg"
    return f"data:{kind};base64,{base64.b64encode(Path(path).read_bytes()).decode()}"


class SceneModel(Protocol):
    """Scores (images x classes, unbounded) of a batch of images, given as bytes."""

    def __call__(self, images: list[bytes]) -> np.ndarray: ...


@dataclass
class OnnxScores:
    """Scores by an ONNX model on the worker's CPU, loaded on first use; ``prepare`` turns an image's bytes into the model's input."""

    path: str
    prepare: object
    session: object = None

    def __call__(self, images: list[bytes]) -> np.ndarray:
        if self.session is None:
            import onnxruntime

            self.session = onnxruntime.InferenceSession(self.path, providers=["CPUExecutionProvider"])
        name = self.session.get_inputs()[0].name
        return self.session.run(None, {name: np.stack([self.prepare(x) for x in images]).astype(np.float32)})[0]


@dataclass
class HashedScores:
    """A stand-in: scores that depend on the image's bytes only."""

    classes: int

    def __call__(self, images: list[bytes]) -> np.ndarray:
        return np.array([np.random.default_rng(list(x[:64]) + [len(x)]).normal(size=self.classes) for x in images]).reshape(len(images), self.classes)


def top_scenes(scores: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(classes, probabilities) of the k best of each row, best first; the lesser class of equal ones."""
    e = np.exp(scores - scores.max(axis=1, keepdims=True))
    p = e / e.sum(axis=1, keepdims=True)
    order = np.argsort(-p, axis=1, kind="stable")[:, :k]
    return order, np.take_along_axis(p, order, axis=1)


def classified_scenes(images: DataFrame, key: str, model: SceneModel, labels: list[str], indoor: list[str], k: int = 5) -> DataFrame:
    """(key, rank, label, indoor_outdoor, confidence, error) of images (key, content): the k best scenes; ``labels`` by class, ``indoor`` those
    of them that are indoors. An image a model fails on has one row with an error."""
    kind = images.schema[key].dataType.simpleString()
    inside = set(indoor)

    def ranked(ids: list, contents: list[bytes]) -> list[tuple]:
        best, p = top_scenes(model(contents), k)
        return [(i, r + 1, labels[c], "indoor" if labels[c] in inside else "outdoor", float(x), None) for n, i in enumerate(ids) for r, (c, x) in enumerate(zip(best[n], p[n]))]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            ids, contents = part[key].tolist(), [bytes(c) for c in part["content"]]
            try:
                rows = ranked(ids, contents)
            except Exception:  # noqa: BLE001  (the images are then tried one by one, so that only the bad ones fail)
                rows = []
                for i, c in zip(ids, contents):
                    try:
                        rows += ranked([i], [c])
                    except Exception as e:  # noqa: BLE001
                        rows.append((i, None, None, None, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=[key, "rank", "label", "indoor_outdoor", "confidence", "error"]).astype({"rank": "Int32"})

    return images.select(key, "content").mapInPandas(run, f"{key} {kind}, rank int, label string, indoor_outdoor string, confidence double, error string")


class Detector(Protocol):
    """Boxes of an image for a prompt: (label, confidence, cx, cy, w, h), all parts of the image's size."""

    def __call__(self, image: bytes, prompt: str, box_threshold: float, text_threshold: float) -> list[tuple[str, float, float, float, float, float]]: ...


def no_boxes(image: bytes, prompt: str, box_threshold: float, text_threshold: float) -> list[tuple]:
    """A stand-in that sees nothing."""
    return []


def hashed_boxes(image: bytes, prompt: str, box_threshold: float, text_threshold: float) -> list[tuple]:
    """A stand-in: one box for each label of the prompt, by its bytes and the image's."""
    out = []
    for label in [x.strip() for x in prompt.split(",") if x.strip()]:
        r = np.random.default_rng(list(label.encode()) + [len(image)]).random(5)
        if r[0] >= box_threshold:
            out.append((label, float(r[0]), float(r[1]), float(r[2]), float(r[3] / 2), float(r[4] / 2)))
    return out


DETECTIONS = "ord bigint, label string, confidence double, x1 double, y1 double, x2 double, y2 double, batch string, error string"


def detected(images: DataFrame, key: str, batches: list[tuple[str, str, float, float]], detector: Detector, source: str) -> DataFrame:
    """(key, DETECTIONS, source) of images (key, content, width, height): all prompt ``batches`` (name, prompt, box and text threshold) one after
    another, boxes numbered through, corners in pixels. A batch of prompts that fails gives a row with an error."""
    kind = images.schema[key].dataType.simpleString()

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [key, *[c.split()[0] for c in DETECTIONS.split(", ")]]
        for part in parts:
            rows: list[tuple] = []
            for i, content, w, h in zip(part[key], part["content"], part["width"], part["height"]):
                n = 0
                for name, prompt, box, text in batches:
                    try:
                        for label, p, cx, cy, bw, bh in detector(bytes(content), prompt, box, text):
                            rows.append((i, n, label, p, (cx - bw / 2) * w, (cy - bh / 2) * h, (cx + bw / 2) * w, (cy + bh / 2) * h, name, None))
                            n += 1
                    except Exception as e:  # noqa: BLE001
                        rows.append((i, None, None, None, None, None, None, None, name, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=names).astype({"ord": "Int64"})

    return images.select(key, "content", "width", "height").mapInPandas(run, f"{key} {kind}, {DETECTIONS}").withColumn("source", F.lit(source))


class InteractionModel(Protocol):
    """Triplets of an image: (verb, confidence, person's box, thing's box), boxes as x1, y1, x2, y2."""

    def __call__(self, image: bytes) -> list[tuple[str, float, tuple, tuple]]: ...


def no_interactions(image: bytes) -> list[tuple]:
    """A stand-in that sees nothing done."""
    return []


@dataclass
class Always:
    """A stand-in that always sees the same."""

    triplets: list[tuple]

    def __call__(self, image: bytes) -> list[tuple]:
        return self.triplets


_BOX = "struct<x1:double,y1:double,x2:double,y2:double>"


def interactions(images: DataFrame, key: str, model: InteractionModel) -> DataFrame:
    """(key, ord, verb, confidence, h, o) of images (key, content), as ``fusion.observed_interactions`` takes them."""
    kind = images.schema[key].dataType.simpleString()

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        box = lambda b: dict(zip(("x1", "y1", "x2", "y2"), map(float, b)))
        for part in parts:
            rows = [(i, n, verb, float(p), box(h), box(o)) for i, c in zip(part[key], part["content"]) for n, (verb, p, h, o) in enumerate(model(bytes(c)))]
            yield pd.DataFrame(rows, columns=[key, "ord", "verb", "confidence", "h", "o"])

    return images.select(key, "content").mapInPandas(run, f"{key} {kind}, ord bigint, verb string, confidence double, h {_BOX}, o {_BOX}")

