"""``python -m weftline``: convert a model, verify two models against each other, clear the cache."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .operators import diff
from .operators.tokenizer import Tokenizer
from .sources.resolver import clear_cache
from .sources.tokenizer_json import from_json
from .spec import ModelSpec


def _model(path: str) -> ModelSpec:
    return from_json(path) if path.endswith(".json") else ModelSpec.load(path)


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="weftline", description=__doc__)
    own = parser.add_subparsers(dest="command", required=True)
    convert = own.add_parser("convert", help="write a model of the public JSON form as tables")
    convert.add_argument("source")
    convert.add_argument("target")
    verify = own.add_parser("verify", help="compare the ids of two models over a Parquet table of texts")
    verify.add_argument("first")
    verify.add_argument("second")
    verify.add_argument("corpus")
    verify.add_argument("--text", default="text")
    verify.add_argument("--key", default="doc_id")
    cache = own.add_parser("cache", help="the cache of compiled models")
    cache.add_argument("action", choices=["clear"])
    args = parser.parse_args(argv)
    if args.command == "convert":
        spec = _model(args.source)
        spec.save(args.target)
        print(f"{spec.vocab_size} tokens, {len(spec.merges)} merges, encoder {spec.encoder}")
        return 0
    if args.command == "cache":
        print(f"{clear_cache()} models deleted")
        return 0
    spark = SparkSession.builder.getOrCreate()
    text = F.col(args.text)
    a, b = (Tokenizer(_model(p)).encode_ids(text) for p in (args.first, args.second))
    df = spark.read.parquet(args.corpus)
    row = diff.verify(df, text, a, b).first()
    print(f"{row.passed} of {row.texts} texts have the same ids")
    for r in diff.mismatches(df, args.key, text, a, b).collect() if row.failed else []:
        print(f"  {r[args.key]}: differ from id {r['at']} on")
    return int(row.failed > 0)


if __name__ == "__main__":
    sys.exit(main())
