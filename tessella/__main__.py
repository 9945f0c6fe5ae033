"""``python -m tessella``: tables, search, dedup-report and query, over folders of JSON lines or Parquet."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import functions as F

from .session import session, ship


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="tessella", description=__doc__)
    parser.add_argument("--master")
    commands = parser.add_subparsers(dest="command", required=True)
    tables = commands.add_parser("tables", help="tables of a folder of JSON lines and their row counts")
    tables.add_argument("root")
    search = commands.add_parser("search", help="BM25F search of a Parquet table of chunks")
    search.add_argument("chunks")
    search.add_argument("query")
    search.add_argument("--id", default="chunk_id")
    search.add_argument("--text", default="text")
    search.add_argument("--top", type=int, default=5)
    query = commands.add_parser("query", help="a registered query over a folder of tables")
    query.add_argument("name")
    query.add_argument("sf_dir")
    query.add_argument("--rows", type=int, default=20)
    args = parser.parse_args(argv)
    spark = session(master=args.master)
    spark.sparkContext.setLogLevel("ERROR")
    ship(spark)
    if args.command == "tables":
        from .sources.files import Dataset

        data = Dataset(spark, args.root)
        for name in data.tables():
            print(name, data.count(name), sep="\t")
    elif args.command == "search":
        from .functions.text import query_tokens, snippet
        from .operators import rank

        docs = spark.read.parquet(args.chunks).withColumnRenamed(args.id, "chunk_id").withColumnRenamed(args.text, "text")
        asked = spark.createDataFrame([(0, args.query)], "query_id long, query string")
        fields = {f: w for f, w in {"title": 3.0, "text": 1.0, "category": 0.8, "url": 0.2}.items() if f in docs.columns}
        hits = rank.top_k(rank.bm25f(docs, asked, fields), args.top).join(docs.select("chunk_id", "text"), "chunk_id")
        for r in hits.select("rank", "chunk_id", "score", snippet("text", query_tokens(F.lit(args.query))).alias("s")).orderBy("rank").collect():
            print(r["rank"], r["chunk_id"], round(r["score"], 4), r["s"].replace("\n", " "), sep="\t")
    else:
        from .plans.queries import QUERIES

        QUERIES[args.name](spark, args.sf_dir).show(args.rows, truncate=80)
    return 0


if __name__ == "__main__":
    sys.exit(main())
