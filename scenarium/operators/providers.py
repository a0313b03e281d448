"""The boundary to models: batched functions behind one interface, with deterministic stand-ins, retries and resuming."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scenarium.storage import Scratch


class Provider(Protocol):
    """Answers to a batch of prompts (and images as paths, or empty text); an exception means that all of the batch failed."""

    def __call__(self, prompts: list[str], images: list[str]) -> list[str]: ...


def echo(prompts: list[str], images: list[str]) -> list[str]:
    """A stand-in: a minimal prediction that depends on nothing but its input."""
    code = [hashlib.sha256(f"{p}|{i}".encode()).hexdigest() for p, i in zip(prompts, images)]
    return [f'{{"core": {{"scene": {{"label": "scene {c[0]}", "indoor_outdoor": "unknown"}}, "visual_terms": [], "nodes": [], "caption": "A visual scene {c[:4]}."}}}}' for c in code]


def hashed_vectors(texts: list[str], size: int = 64) -> list[list[float]]:
    """A stand-in for a sentence encoder: unit vectors of hashed words."""
    out = []
    for t in texts:
        v = [0.0] * size
        for w in t.lower().split():
            v[int(hashlib.md5(w.encode()).hexdigest(), 16) % size] += 1.0
        n = sum(x * x for x in v) ** 0.5
        out.append([x / n for x in v] if n else v)
    return out


def encoded(rows: DataFrame, key: str, texts: list[str], encoder: Callable[[list[str]], list[list[float]]] = hashed_vectors) -> DataFrame:
    """(key, <text>_vector ...) of the ``texts`` columns, an Arrow batch at a time; null texts count as empty."""
    kind = rows.schema[key].dataType.simpleString()

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield pd.DataFrame({key: part[key]} | {f"{c}_vector": encoder(part[c].fillna("").tolist()) for c in texts})

    return rows.select(key, *texts).mapInPandas(run, f"{key} {kind}, " + ", ".join(f"{c}_vector array<double>" for c in texts))


def asked(rows: DataFrame, key: str, provider: Provider) -> DataFrame:
    """(key, answer, error) of rows (key, prompt, image), an Arrow batch at a time. A failed batch is asked row by row."""
    kind = rows.schema[key].dataType.simpleString()

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            p, i = part["prompt"].fillna("").tolist(), part["image"].fillna("").tolist()
            try:
                answers, errors = provider(p, i), [None] * len(p)
            except Exception:  # noqa: BLE001
                answers, errors = [], []
                for a, b in zip(p, i):
                    try:
                        answers += provider([a], [b])
                        errors.append(None)
                    except Exception as e:  # noqa: BLE001
                        answers.append(None)
                        errors.append(f"{type(e).__name__}: {e}")
            yield pd.DataFrame({key: part[key], "answer": answers, "error": errors})

    return rows.select(key, "prompt", "image").mapInPandas(run, f"{key} {kind}, answer string, error string")


def with_retries(rows: DataFrame, key: str, step: Callable[[DataFrame], DataFrame], max_retries: int = 2) -> DataFrame:
    """Results (key, ..., error) of ``step`` over rows; what failed is tried again, ``max_retries`` times. Each round is written once."""
    scratch = Scratch(rows.sparkSession, "retries")
    done: DataFrame | None = None
    pending = rows
    for round_ in range(max_retries + 1):
        got = scratch.write(step(pending), "round")
        good = got if round_ == max_retries else got.where("error is null")
        done = good if done is None else done.unionByName(good)
        failed = got.where("error is not null").select(key)
        if round_ == max_retries or failed.isEmpty():
            break
        pending = rows.join(failed, key, "left_semi")
    return done


def not_done(rows: DataFrame, outputs: DataFrame, key: str) -> DataFrame:
    """Rows without an output yet."""
    return rows.join(outputs.select(key).distinct(), key, "left_anti")


def disjoint(source: str, target: str) -> None:
    """An error if one folder is, or is in, the other."""
    a, b = (x.rstrip("/") + "/" for x in (source, target))
    if a.startswith(b) or b.startswith(a):
        raise ValueError(f"{source} and {target} overlap")


def call_gates(scene: Column, allowed: list[str], terms: Column) -> dict[str, Column]:
    """Which calls of the staged flow are worth making: none after an unknown scene, no mapping to nodes without terms."""
    known = F.coalesce(scene.isin(allowed), F.lit(False))
    return {"ask_terms": known, "ask_nodes": known & (F.size(F.coalesce(terms, F.array().cast("array<string>"))) > 0), "ask_captions": known}


def rule_text(groups: Column) -> Column:
    """A rule in words: ``(A OR B) AND C``."""
    one = lambda g: F.when(F.size(g) > 1, F.concat(F.lit("("), F.array_join(g, " OR "), F.lit(")"))).otherwise(F.array_join(g, ""))
    return F.array_join(F.transform(groups, one), " AND ")


#: Prompt templates by call: what is asked, and which closed lists it names.
PROMPTS = {
    "single": "Describe the image as JSON with scene, visual_terms, nodes and captions. Use only these scenes: {scenes}. Terms: {terms}. Nodes: {nodes}.",
    "free_scene": "Describe the image as JSON with a scene in your own words, visual_terms and nodes. Terms: {terms}. Nodes: {nodes}.",
    "free_visual": "List every visible object of the image as JSON under visual_terms, in your own words.",
    "map_terms": "Map each of these words to one of the allowed terms, or leave it out, as JSON under mapping. Terms: {terms}.",
    "map_scene": "Choose the scene of the image from these as JSON under scene: {scenes}.",
    "scene_terms": "Name the scene and the visual_terms of the image as JSON. Scenes: {scenes}. Terms: {terms}.",
    "nodes": "Name the sounds that what is visible would make, as JSON under nodes. Nodes: {nodes}.",
    "nodes_from_rules": "Name the nodes whose rule the visual_terms satisfy, as JSON under nodes. Rules: {rules}.",
    "captions": "Write caption and acoustic_caption for this description as JSON.",
    "legacy": "Describe the image as JSON with scene, entities, observed_interactions, spatial_relations, environment and caption. Nodes: {nodes}.",
}


def prompt(call: str, **lists: Column) -> Column:
    """A call's prompt with its lists (ARRAY<STRING>) filled in."""
    text = F.lit(PROMPTS[call])
    for name, items in lists.items():
        text = F.replace(text, F.lit("{" + name + "}"), F.array_join(items, ", "))
    return text
