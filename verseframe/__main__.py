"""python -m verseframe: runs a query, prepares a corpus or reports on a review file, and writes the result."""

from __future__ import annotations

import argparse
import importlib

from pyspark.sql import DataFrame, SparkSession, functions as F

from verseframe.operators import corpus, reviews
from verseframe.session import get_session
from verseframe.sources import files, sinks

PLANS = ("core_problems", "text_queries", "review_queries", "people_queries", "prosody_queries", "stream_queries")


def known_queries() -> dict:
    return {name: q for m in PLANS for name, q in importlib.import_module(f"verseframe.plans.{m}").QUERIES.items()}


def review_report(spark: SparkSession, path: str) -> DataFrame:
    """model, n_reviews and the mean of every dimension, of a file of review results."""
    means = reviews.means(files.read_scores(spark, path), ["model"])
    return means.select("model", "n_reviews", *[F.round(d, 3).alias(d) for d in reviews.DIMENSIONS])


def prepare(spark: SparkSession, source: str, args: argparse.Namespace) -> DataFrame:
    docs = files.read_documents(spark, source, recursive=True)
    size_of = corpus.token_counter(args.tokenizer) if args.tokenizer else None
    chunks = corpus.prepared_samples(docs, "file", "text", tuple(args.fragment), args.prefix_rate, args.begin, args.seed, size_of, target=args.target, most=args.most, hard=args.hard, overlap=args.overlap)
    return chunks.select("text")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="verseframe")
    p.add_argument("--out", required=True, help="folder for the result")
    p.add_argument("--format", default="json", choices=("json", "csv", "parquet"))
    p.add_argument("--master")
    sub = p.add_subparsers(dest="what", required=True)
    q = sub.add_parser("query", help="a named query over a folder of tables")
    q.add_argument("name", choices=sorted(known_queries()))
    q.add_argument("data")
    sub.add_parser("reviews", help="means per model of a review file").add_argument("data")
    c = sub.add_parser("prepare", help="a folder of texts as training samples")
    c.add_argument("data")
    for name, kind, value in (("target", int, 600), ("most", int, 800), ("hard", int, 2000), ("overlap", float, 0.15), ("prefix-rate", float, 0.15), ("seed", int, 42), ("begin", str, ""), ("tokenizer", str, "")):
        c.add_argument(f"--{name}", type=kind, default=value)
    c.add_argument("--fragment", action="append", default=[])
    return p


def main(argv: list[str] | None = None) -> str:
    args = parser().parse_args(argv)
    spark = get_session("verseframe", args.master)
    df = known_queries()[args.name](spark, args.data) if args.what == "query" else review_report(spark, args.data) if args.what == "reviews" else prepare(spark, args.data, args)
    if args.format == "csv":
        return sinks.write_csv(df, args.out)
    df.write.mode("overwrite").format(args.format).save(args.out)
    return args.out


if __name__ == "__main__":
    print(main())
