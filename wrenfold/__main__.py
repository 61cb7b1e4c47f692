"""Jobs on a store: stats, recent, search, get, history, save, delete, rollback, export, import, reindex. Run with spark-submit or python -m wrenfold."""

from __future__ import annotations

import argparse
import logging
import os

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from wrenfold.functions import render
from wrenfold.operators.embedders import loaded
from wrenfold.operators.store import KnowledgeStore, default_embedder
from wrenfold.sources.records import read_json, to_json
from wrenfold.streaming.upserts import SAVES


def main(arguments: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="wrenfold", description=__doc__)
    parser.add_argument("--root", default=os.environ.get("WRENFOLD_ROOT", "knowledge"), help="folder of the store")
    parser.add_argument("--lexical-only", action="store_true", help="neither make nor search vectors")
    parser.add_argument("--tensors", help="tensor file of a static embedding model")
    parser.add_argument("--tokenizer", help="the model's tokenizer file")
    jobs = parser.add_subparsers(dest="job", required=True)
    jobs.add_parser("stats")
    jobs.add_parser("recent")
    jobs.add_parser("reindex")
    jobs.add_parser("get").add_argument("id")
    jobs.add_parser("history").add_argument("id")
    jobs.add_parser("delete").add_argument("id", nargs="+")
    back = jobs.add_parser("rollback")
    back.add_argument("id")
    back.add_argument("version", type=int)
    search = jobs.add_parser("search")
    search.add_argument("query")
    search.add_argument("--limit", type=int, default=5)
    search.add_argument("--scope")
    search.add_argument("--tag", action="append", default=[])
    search.add_argument("--compact", action="store_true")
    jobs.add_parser("save").add_argument("input", help="JSON lines of saves")
    export = jobs.add_parser("export")
    export.add_argument("-o", "--output", required=True)
    export.add_argument("-p", "--scope")
    export.add_argument("--jsonl", action="store_true")
    load = jobs.add_parser("import")
    load.add_argument("-i", "--input", required=True)
    load.add_argument("-m", "--merge", action="store_true", help="match entries by key, not by id")
    a = parser.parse_args(arguments)

    logging.basicConfig(level=os.environ.get("WRENFOLD_LOG", "WARNING"))
    spark = SparkSession.builder.appName("wrenfold").getOrCreate()
    if bool(a.tensors) != bool(a.tokenizer):
        parser.error("--tensors and --tokenizer go together")
    embed = None if a.lexical_only else loaded(spark, a.tensors, a.tokenizer) if a.tensors else default_embedder
    store = KnowledgeStore(spark, a.root, embed)
    if a.job == "stats":
        print(store.report())
    elif a.job == "recent":
        print(store.recent_markdown())
    elif a.job == "reindex":
        store.reindex()
    elif a.job == "get":
        rows = store.get(a.id)
        print(*[r["j"] for r in rows.select(to_json(rows).alias("j")).collect()], sep="\n")  # one entry
    elif a.job == "history":
        store.history(a.id).select("version", "operation", "timestamp", "title").show(truncate=False)
    elif a.job == "delete":
        print(f"Deleted {store.delete(a.id)} knowledge entries")
    elif a.job == "rollback":
        store.rollback(a.id, a.version)
        print(f"Restored version {a.version} of {a.id}")
    elif a.job == "save":
        store.save(spark.read.schema(SAVES).json(a.input)).select("seq", "entry_id", "reason", "deduplicated", "merged", "secrets_redacted").show(truncate=False)
    elif a.job == "search":
        rows = store.search(a.query, a.limit, a.scope, a.tag)
        cols = {c: F.col(c) for c in rows.columns}
        text = render.compact(F.col("place"), cols) if a.compact else render.full(F.col("place"), cols, F.col("keyword_rank"), F.col("semantic_score"))
        found = rows.select("place", "ranking", text.alias("m")).orderBy("place").collect()  # `limit` rows
        label = found[0]["ranking"] if found else ""
        print(spark.range(1).select(render.found_line(F.lit(len(found)), F.lit(a.query), F.lit(label))).first()[0] + "".join(r["m"] for r in found))
    elif a.job == "export":
        print(f"Exported {store.export_records(a.output, a.scope, a.jsonl)} knowledge entries to {a.output}")
    else:
        print(f"Imported {store.import_records(read_json(spark, a.input), a.merge)} knowledge entries")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
