"""Command line: ``python -m arborspark build IN OUT``, then ``find``, ``read``, ``outline``, ``children``, ``parent``, ``search`` on OUT."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arborspark.engine import Engine
from arborspark.operators import markdown


def shown(rows: DataFrame, limit: int) -> None:
    for line in rows.limit(limit).toJSON().collect():
        print(line)


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="arborspark", description=__doc__)
    sub = top.add_subparsers(dest="command", required=True)
    add = lambda name, *args: [sub.choices[name].add_argument(a) for a in args] if sub.add_parser(name) else None
    add("build", "source", "index")
    for name, args in {"find": ["question"], "search": ["question"], "outline": [], "read": ["doc", "node"], "children": ["doc", "node"], "parent": ["doc", "node"]}.items():
        add(name, "index", *args)
        sub.choices[name].add_argument("--limit", type=int, default=20)
    for name in ("find", "search"):
        sub.choices[name].add_argument("--need", action="append", default=[])
    return top


def main(argv: list[str] | None = None) -> None:
    a = parser().parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    engine = Engine()
    if a.command == "build":
        docs = spark.read.text(a.source, wholetext=True).select(F.input_file_name().alias("doc_id"), F.col("value").alias("text"))
        units, nodes = engine.build(docs)
        for name, rows in {"docs": docs, "units": units, "nodes": nodes}.items():
            rows.write.parquet(f"{a.index}/{name}")
        print(json.dumps({"index": a.index, "nodes": nodes.count()}))
        return
    docs, units, nodes = (spark.read.parquet(f"{a.index}/{n}") for n in ("docs", "units", "nodes"))
    if a.command == "outline":
        shown(markdown.outline(nodes).orderBy("doc_id", "start"), a.limit)
    elif a.command == "find":
        asked = spark.createDataFrame([("q", " ".join([a.question, *a.need]))], "question string, text string")
        hits = engine.find(docs, nodes, asked, top=a.limit)
        shown(hits.join(nodes.select("doc_id", "node_id", "title"), ["doc_id", "node_id"]).orderBy("rank"), a.limit)
    elif a.command == "search":
        shown(engine.retrieve(units, nodes, a.question, a.need)["selected"].orderBy("doc_id", "rank"), a.limit)
    else:
        one = (F.col("doc_id") == a.doc) & (F.col("node_id") == a.node)
        if a.command == "read":
            shown(engine.read(docs, nodes, nodes.where(one).select("doc_id", "node_id")), a.limit)
        elif a.command == "children":
            shown(nodes.where((F.col("doc_id") == a.doc) & (F.col("parent_id") == a.node)).orderBy("start"), a.limit)
        else:
            up = nodes.where(one).select("doc_id", F.col("parent_id").alias("node_id"))
            shown(nodes.join(up, ["doc_id", "node_id"], "left_semi"), a.limit)


if __name__ == "__main__":
    main()
