"""Command line: ``python -m hazlens.cli train|score|watch|panels|query``; under spark-submit the master comes from there."""

from __future__ import annotations

import argparse
import importlib
import importlib.util

from pyspark.sql import functions as F

from hazlens import session
from hazlens.functions import lexicon as lex
from hazlens.operators import classify, evaluate, tagging
from hazlens.plans import dashboard
from hazlens.sources import reports, sinks
from hazlens.streaming import feeds


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="hazlens", description="Safety-report analytics on Spark.")
    parser.add_argument("--master", help="Spark master; leave out under spark-submit")
    commands = parser.add_subparsers(dest="command", required=True)
    told = {
        "train": "fit a classifier on labelled reports, judge it on a fold it never saw, and store it",
        "score": "class, score, rules and evidence of every report",
        "watch": "the same scores for reports as they arrive",
        "panels": "the tables of the dashboard",
    }
    for name, text in told.items():
        sub = commands.add_parser(name, help=text)
        sub.add_argument("input")
        sub.add_argument("output")
        sub.add_argument("--format", default="parquet", help="of the input: parquet, csv, json")
        if name == "train":
            sub.add_argument("--label", default="sif_label")
        else:
            sub.add_argument("--model", help="a folder that train wrote; without one the rule of energy and failed control decides")
            sub.add_argument("--threshold", type=float, default=0.5)
            sub.add_argument("--lexicon", help="JSON lines of rule_id, pattern, weight; ENERGY and CONTROL name the patterns of the rule that decides without a model")
            sub.add_argument("--to", default="parquet", help="of the output")
        if name == "panels":
            sub.add_argument("--split", help="the day between past and present, for drift")
            sub.add_argument("--clusters", type=int, default=0, help="how many groups of reports by their words")
        if name == "watch":
            sub.add_argument("--checkpoint", required=True)
            sub.add_argument("--every", help="such as '1 minute'; without it what is there now is worked through")
    sub = commands.add_parser("query", help="one registered query over a data folder")
    sub.add_argument("name")
    sub.add_argument("folder")
    return parser


def _train(rows, label: str, output: str) -> None:
    rows = rows.where(F.col(label).isNotNull() & F.col("narrative").isNotNull())
    held = classify.fold(F.xxhash64("report_id")) == 0
    model = classify.Ensemble.fit(rows.where(~held), label)
    evaluate.scores(model.score(rows.where(held)), label, "sif_pred").coalesce(1).write.mode("overwrite").json(f"{output}/held_out")
    model.save(output)


def main(argv: list[str] | None = None) -> int:
    args = _parser().parse_args(argv)
    spark = session.build(args.master)
    if args.command == "query":
        from hazlens.plans import catalogue, explained, served  # noqa: F401  (registers their queries)

        known = dict(catalogue.QUERIES)
        if importlib.util.find_spec("__spark_entry__"):
            known |= importlib.import_module("__spark_entry__").queries()
        known[args.name](spark, args.folder).show(50, truncate=80)
        return 0
    if args.command == "train":
        _train(reports.read(spark, args.input, args.format), args.label, args.output)
        return 0
    model = classify.Ensemble.load(args.model) if args.model else None
    entries, patterns_of = lex.read(spark, args.lexicon) if args.lexicon else (lex.SAFETY, {})
    told = {"lexicon": entries, "energy": patterns_of.get("ENERGY", lex.ENERGY), "control_failed": patterns_of.get("CONTROL", lex.CONTROL_FAILED), "model": model, "threshold": args.threshold}
    if args.command == "watch":
        rows = dashboard.prepared(reports.stream(spark, args.input, fmt=args.format), **told)
        trigger = {"processingTime": args.every} if args.every else None
        feeds.start(rows, args.checkpoint, args.output, trigger=trigger, fmt=args.to).awaitTermination()
        return 0
    rows = dashboard.prepared(reports.read(spark, args.input, args.format), **told)
    if args.command == "score":
        flat = rows.withColumn("rules", F.array_join("rules", ",")).drop("lsr_labels")
        sinks.export(flat, f"{args.output}/scores", args.to)
        sinks.export(tagging.evidence(rows, entries), f"{args.output}/evidence", args.to)
        return 0
    found = dashboard.panels(rows, split=args.split)
    if args.clusters:
        found["clusters"] = dashboard.cluster_panel(rows, args.clusters).withColumn("terms", F.array_join("terms", " "))
    for name, panel in found.items():
        sinks.export(panel, f"{args.output}/{name}", args.to, one_file=True)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
