"""Command line: python -m catalith ingest | build | audit | lift | status | list | show | search | review | correct | schema | query | summary | export."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from catalith import engine
from catalith.operators import views

REQUIRED = "category_id string, channel string, code string, variant_defining boolean"
LISTED, FLAGGED, WIDTH = 100, 25, 38


def main(given: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="catalith")
    parser.add_argument("--root", required=True, help="folder of the catalog's tables")
    commands = parser.add_subparsers(dest="command", required=True)
    ingest = commands.add_parser("ingest", help="take in new feeds of a folder")
    ingest.add_argument("feeds")
    ingest.add_argument("--sep", help="separator of all feeds; each feed is looked at without it")
    build = commands.add_parser("build", help="golden records, conflicts and scores")
    build.add_argument("required", help="CSV of category_id, channel, code, variant_defining")
    build.add_argument("--rule", action="append", default=[], metavar="NAME=CONDITION", help="a condition over numeric codes, such as fits=width <= height")
    commands.add_parser("audit", help="what each step read, wrote and refused")
    commands.add_parser("lift", help="scorecard of the last build beside the one before")
    commands.add_parser("status", help="sources by status and rows of the tables")
    listed = commands.add_parser("list", help="products with their scores")
    listed.add_argument("--manufacturer")
    listed.add_argument("--category")
    show = commands.add_parser("show", help="values of a product, by id or part number")
    show.add_argument("product")
    search = commands.add_parser("search", help="products by words and numbers")
    search.add_argument("question")
    commands.add_parser("review", help="what a reviewer should look at first")
    correct = commands.add_parser("correct", help="append a human correction; build applies it")
    for name in ("product_id", "code", "value"):
        correct.add_argument(name)
    correct.add_argument("--reviewer", default="reviewer")
    commands.add_parser("schema", help="codes of each category")
    query = commands.add_parser("query", help="a reading SQL statement")
    query.add_argument("statement")
    query.add_argument("--rows", type=int, default=200)
    commands.add_parser("summary", help="rows of each table")
    export = commands.add_parser("export", help="write a channel export")
    export.add_argument("kind", choices=["json", "record", "csv", "xml"])
    export.add_argument("target")
    export.add_argument("--ready", action="store_true")
    args = parser.parse_args(given)
    spark = SparkSession.builder.appName("catalith").getOrCreate()
    if args.command == "ingest":
        print(engine.ingest(spark, args.feeds, args.root, args.sep), "files taken in")
    elif args.command == "build":
        rules = dict(r.split("=", 1) for r in args.rule)
        for name, rows in engine.build(spark, args.root, spark.read.schema(REQUIRED).option("header", "true").csv(args.required), rules).items():
            print(rows, name)
    elif args.command == "audit":
        engine.audit(spark, args.root).show(LISTED, WIDTH)
    elif args.command == "lift":
        engine.lift(spark, args.root).show(LISTED, WIDTH)
    elif args.command == "status":
        engine.status(spark, args.root).show(LISTED, WIDTH)
    elif args.command == "list":
        engine.records(spark, args.root, args.manufacturer, args.category).show(LISTED, WIDTH)
    elif args.command == "show":
        engine.show(spark, args.root, args.product).show(LISTED, WIDTH)
    elif args.command == "search":
        engine.find(spark, args.root, args.question).show(LISTED, WIDTH)
    elif args.command == "review":
        engine.review(spark, args.root, FLAGGED).show(FLAGGED, WIDTH)
    elif args.command == "correct":
        engine.correct(spark, args.root, args.product_id, args.code, args.value, args.reviewer)
    elif args.command == "schema":
        engine.schema(spark, args.root).show(LISTED, WIDTH)
    elif args.command == "query":
        engine.ask(spark, args.root, args.statement).show(args.rows, WIDTH)
    elif args.command == "summary":
        views.table_summary(engine.views(spark, args.root)).show()
    else:
        engine.export(spark, args.root, args.target, args.kind, args.ready)


if __name__ == "__main__":
    main()
