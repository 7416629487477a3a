"""Command line: ``python -m corvida cohort|classes|split|train|select|evaluate|ensemble|measure``; tables are parquet, records JSON."""

from __future__ import annotations

import argparse
import json

from corvida.operators import scoring
from corvida.plans import workflow
from corvida.session import build
from corvida.sources import sinks, tables


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="corvida")
    commands = parser.add_subparsers(dest="command", required=True)
    one = commands.add_parser("cohort", help="import a folder of case files and images, and publish it")
    one.add_argument("source")
    one.add_argument("output")
    one.add_argument("--expected", help="JSON list of name, sha256 and size that the folder must equal")
    one = commands.add_parser("classes", help="rows of two class folders, to be split")
    one.add_argument("source")
    one.add_argument("output")
    which = one.add_mutually_exclusive_group(required=True)
    which.add_argument("--groups", help="CSV of path and group")
    which.add_argument("--independent", action="store_true")
    one = commands.add_parser("train", help="fit a scorer for each seed on the train and validation parts of id, x, y, split")
    one.add_argument("rows")
    one.add_argument("output")
    one.add_argument("--seeds", type=int, nargs="+", required=True)
    one.add_argument("--epochs", type=int, default=50)
    one.add_argument("--batch-size", type=int, default=64)
    one.add_argument("--patience", type=int, default=5)
    one = commands.add_parser("split", help="make a split of sample_id, group, content_hash, label")
    one.add_argument("rows")
    one.add_argument("output")
    one.add_argument("--train", type=float, default=0.7)
    one.add_argument("--validation", type=float, default=0.15)
    one.add_argument("--seed", type=int, default=0)
    one.add_argument("--method", choices=("runs", "greedy", "rank"), default="runs")
    one.add_argument("--cohort", help="published cohort whose labelled images the rows must be")
    for name, text in (("select", "thresholds from validation scores"), ("evaluate", "metrics on test scores"), ("ensemble", "the same for two or more models and their mean"), ("measure", "repeated-seed measurement")):
        one = commands.add_parser(name, help=text)
        one.add_argument("manifest")
        one.add_argument("scores")
        one.add_argument("output")
        if name in ("evaluate", "ensemble"):
            which = one.add_mutually_exclusive_group(required=True)
            which.add_argument("--threshold", type=float)
            which.add_argument("--selection")
            one.add_argument("--history", nargs="+", required=True, help="tables of model and content_hash: what each model was fitted and chosen on")
        if name == "measure":
            one.add_argument("--repetitions", type=int, default=2000)
            one.add_argument("--seed", type=int, default=1729)
    args = parser.parse_args(argv)
    spark = build()
    if args.command == "cohort":
        expected = tables.expected_files(spark, args.expected) if args.expected else None
        workflow.publish_cohort(workflow.import_cohort(spark, args.source, expected=expected), args.output, args.source)
        return
    if args.command == "classes":
        sinks.publish(workflow.import_classes(spark, args.source, args.groups, args.independent), args.output)
        return
    if args.command == "train":
        rows = spark.read.parquet(args.rows)
        sinks.publish(scoring.train_seeds(rows.where("split = 'train'"), rows.where("split = 'validation'"), args.seeds, args.epochs, args.batch_size, args.patience), args.output)
        return
    if args.command == "split":
        cohort = workflow.load_cohort(spark, args.cohort) if args.cohort else None
        sinks.publish_split(workflow.create_split(spark.read.parquet(args.rows), args.train, args.validation, args.seed, args.method, cohort), args.output)
        return
    manifest, scores = spark.read.parquet(args.manifest), spark.read.parquet(args.scores)
    if args.command == "select":
        report = workflow.selection_record(manifest, scores)
    elif args.command in ("evaluate", "ensemble"):
        if args.command == "ensemble" and scores.select("model").distinct().limit(2).count() < 2:
            parser.error("an ensemble needs two models or more")
        chosen = workflow.load_selection(args.selection, manifest, scores) if args.selection else None
        report = {"metrics": sinks.metrics_json(workflow.evaluate(manifest, scores, args.threshold, chosen, spark.read.parquet(*args.history)))}
    else:
        report = {name: sinks.metrics_json(rows) for name, rows in workflow.measure(manifest, scores, args.repetitions, args.seed).items()}
    sinks.write_report(report, args.output)
    print(json.dumps(report)[:2000])


if __name__ == "__main__":
    main()
