"""Command line: python -m scenarium.cli COMMAND ...

    list                                        names of all queries
    query NAME --data DIR --out DIR             a query's result as Parquet (or --csv)
    report GROUP --data DIR --out DIR           a metric group (caption, chair, scene, legacy_soundscape, audioset) as CSV
    validate --data DIR --out DIR               validity of every stored prediction as CSV
    ask --manifest CSV --out DIR --server URL   a chat server's answer to each row (image_id, prompt, image), with retries
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scenarium.operators import models, payload, providers
from scenarium.plans import evaluation, records, stored, upkeep
from scenarium.session import build_session, ship
from scenarium.sources import files

REPORTS = {"caption": "report_caption", "chair": "report_chair", "scene": "report_scene", "legacy_soundscape": "report_soundscape", "audioset": "report_audioset"}


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="scenarium", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    top.add_argument("--master", help="of Spark; left to spark-submit if absent")
    commands = top.add_subparsers(dest="command", required=True)
    commands.add_parser("list")
    for name, first in (("query", "name"), ("report", "group"), ("validate", None)):
        one = commands.add_parser(name)
        if first:
            one.add_argument(first, choices=sorted(REPORTS) if first == "group" else None)
        one.add_argument("--data", required=True, help="folder of the tables")
        one.add_argument("--out", required=True)
        one.add_argument("--csv", action="store_true", help="one CSV instead of Parquet")
    ask = commands.add_parser("ask")
    ask.add_argument("--manifest", required=True)
    ask.add_argument("--out", required=True)
    ask.add_argument("--server", help="base URL of a chat server; without it a stand-in answers")
    ask.add_argument("--model", default="default")
    ask.add_argument("--timeout", type=float, default=600.0)
    ask.add_argument("--max-tokens", type=int, default=2048)
    ask.add_argument("--retries", type=int, default=2)
    return top


def queries() -> dict:
    """Those of the library, and of its optional subpackage's if it is there (as the driver's contract module collects them)."""
    return {name: f for module in (evaluation, records, stored, upkeep) for name, f in module.QUERIES.items()}


def answered(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    """Results (image_id, raw, json, caption, error) of a manifest's rows."""
    rows = files.csv_text(spark, args.manifest)
    rows = rows.select("image_id", *[F.coalesce(c, F.lit("")).alias(c) if c in rows.columns else F.lit("").alias(c) for c in ("prompt", "image")])
    provider = models.ChatServer(args.server, args.model, args.timeout, args.max_tokens) if args.server else providers.echo

    def step(pending: DataFrame) -> DataFrame:
        got = providers.asked(pending, "image_id", provider)
        objects = payload.extracted(got.where("answer is not null"), "image_id", "answer").withColumnRenamed("error", "unread")
        both = got.join(objects, "image_id", "left")
        return both.select("image_id", F.col("answer").alias("raw"), "json", F.get_json_object("json", "$.core.caption").alias("caption"), F.coalesce("error", "unread").alias("error"))

    return providers.with_retries(rows, "image_id", step, args.retries)


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    known = queries()
    if args.command == "list":
        print("\n".join(sorted(known)))
        return 0
    name = {"query": getattr(args, "name", None), "report": REPORTS.get(getattr(args, "group", "")), "validate": "validation_records"}.get(args.command)
    if name is not None and name not in known:
        print(f"no query {name}; see: list", file=sys.stderr)
        return 2
    spark = build_session("scenarium", args.master)
    ship(spark)
    if args.command == "ask":
        results = answered(spark, args)
        files.write_outputs(results, args.out)
        files.retry_report(results.select("image_id", "error"), args.retries).write.mode("overwrite").json(f"{args.out}/report")
        return 0
    out = known[name](spark, args.data)
    if args.csv or args.command != "query":
        files.write_csv(out, args.out)
    else:
        out.write.mode("overwrite").parquet(args.out)
    return 0


if __name__ == "__main__":
    sys.exit(main())
