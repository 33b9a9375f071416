"""Command line over Parquet tables: ``python -m factloom.cli link PASSAGES OUT``, ``status OUT`` and ``report OUT DOCUMENT JSON``."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from factloom.plans import pipeline, views


def main(arguments: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="factloom")
    parser.add_argument("--version", action="version", version="factloom 0.1")
    commands = parser.add_subparsers(dest="command", required=True)
    link = commands.add_parser("link", help="extract facts from passages and relate them")
    link.add_argument("passages")
    link.add_argument("out")
    link.add_argument("--cross-document-only", action="store_true")
    link.add_argument("--tables", help="boxes of the pages' tables; passages need boxes then")
    link.add_argument("--cells", help="cells of the pages' tables, whose numbers become facts")
    status = commands.add_parser("status", help="count relations by type")
    status.add_argument("out")
    report = commands.add_parser("report", help="write a document's facts, relations and failures as JSON lines")
    report.add_argument("out")
    report.add_argument("document")
    report.add_argument("json")
    given = parser.parse_args(arguments)
    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if given.command == "link":
        tables, cells = (path and spark.read.parquet(path) for path in (given.tables, given.cells))
        result = pipeline.run(spark.read.parquet(given.passages), cross_document=given.cross_document_only, tables=tables, cells=cells)
        for name in ("facts", "failures", "relations", "findings"):
            getattr(result, name).write.mode("overwrite").parquet(f"{given.out}/{name}")
    if given.command == "report":
        views.write_json(views.report(given.document, *(spark.read.parquet(f"{given.out}/{k}") for k in ("facts", "relations", "failures"))), given.json)
        return 0
    views.counts(spark.read.parquet(f"{given.out}/relations"), "relation_type").show(truncate=False)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
