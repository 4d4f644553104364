"""Chunks under a token limit: spans split at token ends, units packed on their joined source, several chunkings side by side."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arborspark.functions.arrays import scan
from arborspark.functions.text import tokens
from arborspark.sources.work import importable

#: Ends, in code points, of a text's tokens, in order; what is behind the last one belongs to it.
TokenEnds = Callable[[str], list[int]]


def word_ends(text: str) -> list[int]:
    """The default measure: a token is a run of white space with the word behind it."""
    import re

    return [m.end() for m in re.finditer(r"\s*\S+", text)]


def split_at(text: str, ends: TokenEnds, most: int) -> Iterator[tuple[int, int]]:
    """Spans of at most ``most`` tokens. Each is counted anew from its start, as a tokenizer may join across a cut."""
    at = 0
    while at < len(text):
        found = ends(text[at:])
        if len(found) <= most:
            yield at, len(text)
            return
        if found[most - 1] < 1:
            raise ValueError("the first tokens hold no whole character")
        yield at, at + found[most - 1]
        at += found[most - 1]


def split_spans(units: DataFrame, keys: list[str], most: int = 512, ends: TokenEnds = word_ends) -> DataFrame:
    """``keys, part, start, end, text, cost``: each unit (``start, text``) in parts of at most ``most`` tokens."""
    kinds = ", ".join(f"`{k}` {units.schema[k].dataType.simpleString()}" for k in keys)
    n = len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, out = [], []
            for i, (start, text) in enumerate(zip(batch.column(n).to_pylist(), batch.column(n + 1).to_pylist(), strict=True)):
                for part, (a, b) in enumerate(split_at(text or "", ends, most)):
                    row.append(i)
                    out.append((part, start + a, start + b, text[a:b], len(ends(text[a:b]))))
            at = pa.array(row, pa.int64())
            made = [pa.array([r[k] for r in out], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64()))]
            yield pa.RecordBatch.from_arrays([*[batch.column(k).take(at) for k in range(n)], *made], [*keys, "part", "start", "end", "text", "cost"])

    return importable(units).select(*keys, F.col("start").cast("bigint"), "text").mapInArrow(run, f"{kinds}, part bigint, start bigint, end bigint, text string, cost bigint")


def packed(parts: DataFrame, groups: list[str], budget: int, joint: int = 0) -> DataFrame:
    """``groups, chunk, start, end, n_parts, cost``: contiguous parts of a group (``start, end, cost``) in chunks of at most ``budget`` tokens.

    ``joint`` is what the source between two parts costs.
    """
    row = F.struct(F.col("start").cast("bigint").alias("s"), F.col("end").cast("bigint").alias("e"), F.col("cost").cast("bigint").alias("c"))
    runs = parts.groupBy(*groups).agg(F.array_sort(F.collect_list(row)).alias("xs"))
    start = F.struct(F.lit(0).cast("bigint").alias("used"), F.lit(-1).cast("bigint").alias("chunk"))

    def step(at: Column, x: Column) -> tuple[Column, Column]:
        more = at["used"] + joint + x["c"]
        new = (at["chunk"] < 0) | (more > budget)
        used, chunk = F.when(new, x["c"]).otherwise(more).cast("bigint"), (at["chunk"] + new.cast("bigint")).cast("bigint")
        return F.struct(used.alias("used"), chunk.alias("chunk")), F.struct(chunk.alias("chunk"), x["s"].alias("s"), x["e"].alias("e"), used.alias("used"))

    rows = runs.select(*groups, F.explode(scan(F.col("xs"), start, step, "struct<chunk:bigint,s:bigint,e:bigint,used:bigint>")).alias("r"))
    return rows.groupBy(*groups, "r.chunk").agg(F.min("r.s").alias("start"), F.max("r.e").alias("end"), F.count(F.lit(1)).alias("n_parts"), F.max("r.used").alias("cost"))


def words(text: Column) -> Column:
    return F.size(tokens(text)).cast("bigint")


def side_by_side(units: DataFrame, chunkings: dict[str, DataFrame], budget: int, cost: Callable[[Column], Column] = words) -> DataFrame:
    """``chunking, doc_id, grp, chunk, start, end, n_parts, cost`` of several groupings of the same units (``doc_id, paragraph, grp``)."""
    priced = units.select("doc_id", "paragraph", "start", "end", cost(F.col("text")).alias("cost"))
    out = None
    for name, groups in chunkings.items():
        rows = priced.join(groups.select("doc_id", "paragraph", "grp"), ["doc_id", "paragraph"]).withColumn("chunking", F.lit(name))
        out = rows if out is None else out.unionByName(rows)
    return packed(out, ["chunking", "doc_id", "grp"], budget)


def quantile_groups(units: DataFrame, distance: Callable[[Column, Column], Column], value: Column, section: str, quantile: float = 0.85) -> DataFrame:
    """``doc_id, paragraph, grp``: a new group at each section and where the distance to the unit before lies above its section's quantile."""
    by = Window.partitionBy("doc_id", section).orderBy("paragraph")
    rows = units.select("doc_id", section, "paragraph", value.alias("v"))
    rows = rows.select("doc_id", section, "paragraph", distance(F.lag("v").over(by), F.col("v")).alias("d"), F.row_number().over(by).alias("nth"))
    ends = rows.where("nth > 1").groupBy("doc_id", section).agg(F.percentile("d", F.lit(quantile)).alias("t"))
    rows = rows.join(ends, ["doc_id", section], "left")
    new = (F.col("nth") == 1) | (F.col("d") > F.coalesce("t", F.lit(2.0)))
    return rows.select("doc_id", "paragraph", F.sum(new.cast("bigint")).over(Window.partitionBy("doc_id").orderBy("paragraph")).alias("grp"))
