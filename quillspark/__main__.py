"""Command line: parse documents, build a retrieval index, ask it, review documents.

    python -m quillspark parse FOLDER OUT
    python -m quillspark index RECORDS OUT [--chunk-size 800] [--chunk-overlap 100] [--reset]
    python -m quillspark ask INDEX QUESTION... [--top-k 8]
    python -m quillspark review FOLDER OUT
"""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession

from quillspark.operators import records, retrieval, review
from quillspark.session import ship
from quillspark.sources import docx, files, tree


def arguments(argv: list[str] | None = None) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="quillspark")
    commands = p.add_subparsers(dest="command", required=True)
    for name, takes in (("parse", ("folder", "out")), ("index", ("folder", "out")), ("ask", ("index",)), ("review", ("folder", "out"))):
        c = commands.add_parser(name)
        for a in takes:
            c.add_argument(a)
        if name == "index":
            c.add_argument("--chunk-size", type=int, default=records.CHUNK)
            c.add_argument("--chunk-overlap", type=int, default=records.OVERLAP)
            c.add_argument("--reset", action="store_true", help="write over an index that is there")
        if name == "ask":
            c.add_argument("question", nargs="+")
            c.add_argument("--top-k", type=int, default=8)
    return p.parse_args(argv)


def parse(spark: SparkSession, folder: str, out: str) -> dict:
    parsed = docx.read_documents(spark, folder).persist()
    summary = docx.batch_summary(parsed).persist()
    files.write_batch(parsed, summary, out)
    told = summary.head().asDict(recursive=True) | {"input_folder": folder, "output_folder": out}
    parsed.unpersist()
    summary.unpersist()
    return told


def build(spark: SparkSession, folder: str, out: str, size: int, overlap: int, reset: bool = False) -> dict:
    path = spark._jvm.org.apache.hadoop.fs.Path(out)
    if not reset and path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        raise FileExistsError(f"{out} is there; --reset writes over it")
    found = files.load_records(spark, folder)
    corpus = records.chunks(found, size, overlap)
    retrieval.write_index(out, corpus, records.parents(found))
    told = records.build_summary(found, spark.read.parquet(f"{out}/corpus"), size, overlap)
    told.coalesce(1).write.mode("overwrite").json(f"{out}/summary")
    return told.head().asDict()


def ask(spark: SparkSession, index: str, questions: list[str], k: int) -> list[dict]:
    idx, corpus, parents, _ = retrieval.read_index(spark, index)  # vectors would need the questions' too
    asked = spark.createDataFrame(list(enumerate(questions)), "query_id long, text string")
    rows = retrieval.answer(asked, corpus, parents, k=k, idx=idx).select("query_id", "result", "chunk_id", "source_file", "page", "rerank_score", "text")
    return [r.asDict() for r in rows.orderBy("query_id", "result").collect()]  # k rows a question


def main(argv: list[str] | None = None) -> int:
    a = arguments(argv)
    spark = SparkSession.builder.appName(f"quillspark {a.command}").getOrCreate()
    ship(spark)
    if a.command == "parse":
        told = parse(spark, a.folder, a.out)
    elif a.command == "index":
        told = build(spark, a.folder, a.out, a.chunk_size, a.chunk_overlap, a.reset)
    elif a.command == "ask":
        told = ask(spark, a.index, a.question, a.top_k)
    else:
        found = review.clean_up(review.review(tree.sections(docx.read_documents(spark, a.folder))))
        found.write.mode("overwrite").json(a.out)
        told = {"violations": spark.read.json(a.out).count()}
    print(json.dumps(told, ensure_ascii=False, indent=2, default=str))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
