"""Analyse files from the command line: ``python -m textweft --input FILE --index FOLDER --chunks FOLDER``."""

from __future__ import annotations

import argparse
import json
from pathlib import Path


def options() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="textweft", description="Report which indexed papers a file shares text with.")
    p.add_argument("--input", required=True, help="file, folder or pattern of files to analyse")
    p.add_argument("--output", help="where the report goes; to standard output without it")
    p.add_argument("--index", required=True, help="folder of the vector index")
    p.add_argument("--chunks", required=True, help="folder of the chunk table the index was built from")
    p.add_argument("--archive", help="source archive of the input file, preferred to its own text")
    p.add_argument("--width", type=int, default=256, help="columns of the hashed term counts")
    p.add_argument("--threshold", type=float, default=0.85)
    p.add_argument("--top-k", type=int, default=5)
    p.add_argument("--max-sources", type=int, default=10)
    p.add_argument("--max-matches", type=int, default=5)
    p.add_argument("--master", default=None, help="Spark master")
    p.add_argument("--pretty", action="store_true", help="indent the report")
    return p


def run(spark, args: argparse.Namespace) -> list[dict]:
    """The reports, one a file; written to ``output`` if that is given."""
    from pyspark.sql import functions as F

    from .operators.embedding import hashed_terms
    from .operators.index import read_index
    from .plans import pipelines
    from .sources import files

    embedder = hashed_terms(args.width)
    asked = spark.read.format("binaryFile").load(args.input).select("path", "content")
    archives = None
    if args.archive:
        # one archive, for the one file that is asked about
        only = asked.select("path").first()
        archives = files.archive_sources(spark.read.format("binaryFile").load(args.archive)).select(F.lit(only and only["path"]).alias("path"), "latex")
    reports = pipelines.analyze(asked, read_index(spark, args.index, embedder), spark.read.parquet(args.chunks), embedder, args.threshold, args.top_k, args.max_sources, args.max_matches, archives)
    out = [json.loads(r["report"]) for r in reports.orderBy("path").toLocalIterator()]
    text = json.dumps(out[0] if len(out) == 1 else out, ensure_ascii=False, indent=2 if args.pretty else None)
    if args.output:
        Path(args.output).parent.mkdir(parents=True, exist_ok=True)
        Path(args.output).write_text(text, encoding="utf-8")
    else:
        print(text)
    return out


def main() -> None:
    from pyspark.sql import SparkSession

    args = options().parse_args()
    builder = SparkSession.builder.appName("textweft")
    run((builder.master(args.master) if args.master else builder).getOrCreate(), args)


if __name__ == "__main__":
    main()
