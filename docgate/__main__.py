"""python -m docgate COMMAND: the local run, its steps and its reports from a shell."""

from __future__ import annotations

import argparse
import json
import sys
import uuid


def parser() -> argparse.ArgumentParser:
    made = argparse.ArgumentParser(prog="docgate")
    commands = made.add_subparsers(dest="command", required=True)

    def command(name: str, what: str, **options: bool) -> None:
        own = commands.add_parser(name, help=what)
        for option, required in options.items():
            own.add_argument(f"--{option}", required=required)

    command("run", "clean, gate and deliver the Markdown below a folder", input=True, output=True)
    command("batch", "the same with structure and repairs, one run at a time, without what was delivered before", input=True, output=True, manifest=False)
    command("clean", "clean texts and tell what each rule changed", input=True, output=True)
    command("gate", "the codes of texts as they are", input=True)
    command("chunks", "texts in chunks for review", input=True, output=True)
    command("pdf", "texts as PDF files in a table", input=True, output=True)
    command("quality-report", "count a delivery's statuses and codes", output=True)
    command("cost-report", "calls and costs of a log by stage", log=True)
    command("batch-report", "latest states of a batch log", log=True)
    command("inspect", "list the sources below a folder", input=True, output=False)
    command("profiles", "list the document profiles")
    command("rules", "list the cleaning rules with their risk")
    command("codes", "list the codes of the gate, and which block")
    command("queries", "list the registered queries")
    return made


def show(rows) -> None:
    for row in rows:
        print(json.dumps(row, ensure_ascii=False, default=str))


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)

    from docgate.functions import lexicon

    match args.command:
        case "profiles":
            print("\n".join(lexicon.PROFILES))
            return 0
        case "rules":
            show({"rule_id": k, "description": a, "risk_level": b, "write_mode": c} for k, (a, b, c) in lexicon.RULES.items())
            return 0
        case "codes":
            show({"code": c, "blocks": c in lexicon.BLOCKING} for c in lexicon.CODES)
            return 0
        case "queries":
            from docgate.plans import catalog

            print("\n".join(catalog.queries()))
            return 0

    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F

    from docgate.operators import clean, finalize, folds, gate
    from docgate.sources import files, locks, pdf

    spark = SparkSession.builder.appName("docgate").getOrCreate()
    rows = lambda df: (r.asDict(recursive=True) for r in df.toLocalIterator())
    match args.command:
        case "inspect":
            show(rows(files.discover(spark, args.input, skip_generated=args.output is not None, output=args.output)))
            return 0
        case "clean":
            made = clean.with_audit(files.texts(spark, args.input))
            made.write.mode("overwrite").parquet(args.output)
            show(rows(spark.read.parquet(args.output).select(F.explode("audit.rule_id").alias("rule_id")).groupBy("rule_id").count()))
            return 0
        case "gate":
            show(rows(gate.gate(files.texts(spark, args.input)).select("doc_id", "accepted", "blocking", "warnings")))
            return 0
        case "chunks":
            folds.chunked(files.texts(spark, args.input)).write.mode("overwrite").parquet(args.output)
            return 0
        case "pdf":
            pdf.documents(files.texts(spark, args.input)).write.mode("overwrite").parquet(args.output)
            return 0
        case "cost-report":
            calls = files.log(spark, args.log)
            show(rows(calls.groupBy("stage").agg(F.count(F.lit(1)).alias("calls"), F.count_if(F.col("status") != "ok").alias("failed"), F.sum("duration_seconds").alias("seconds"), F.sum("estimated_cost").alias("cost"))))
            return 0
        case "batch-report":
            show(rows(files.latest_rows(files.log(spark, args.log, files.BATCH_STATE), "source_path", "finished_at").groupBy("status").count()))
            return 0
        case "run":
            sources = files.texts(spark, args.input)
            files.deliver(gate.gate(clean.clean(sources)), args.output, sources)
        case "batch":
            lock = locks.acquire(args.output + ".run", uuid.uuid4().hex)
            try:
                sources = files.texts(spark, args.input)
                if args.manifest:
                    sources = sources.join(files.delivered_before(sources, spark.read.parquet(args.manifest)).select("doc_id"), "doc_id", "left_anti")
                made = finalize.repair(finalize.finalize(clean.clean(sources)))
                files.deliver(gate.gate(clean.clean(made)), args.output, sources)
            except BaseException:
                lock.release("failed")
                raise
            lock.release("finished")
    delivered = spark.read.parquet(args.output)
    codes = delivered.select(F.explode(F.split("blocking", ",")).alias("code")).filter("code <> ''").groupBy("code").count()
    status = {r["status"]: r["count"] for r in delivered.groupBy("status").count().collect()}
    print(json.dumps({"status": status, "blocking": {r["code"]: r["count"] for r in codes.collect()}}, ensure_ascii=False))
    return 0 if set(status) <= {"passed"} else 1


if __name__ == "__main__":
    sys.exit(main())
