"""Token counts from distinct pre-tokens.

Pieces are counted once for each distinct pre-token of the whole corpus; per-document
pre-token frequencies are joined to those counts and summed. No ids are materialised.
The most frequent pre-tokens, a table of fixed size, are joined on the map side, so no
join key is hot; only the rest is shuffled, each by a 64-bit hash of it. Pre-tokens whose
hashes clash, which the distinct ones tell, are joined on the map side as well, so that
counts are exact.

A pre-token is a run of spaces with the non-spaces behind it: no piece of the vocabulary
has a space mark behind another character, so no merge crosses such a boundary
(:func:`boundaries_hold` checks it on the model before anything is counted).

Defined results: a null text counts as empty; the empty text has 0 bytes and 0 tokens;
repeated rows and repeated or null ids give one row each; an empty table gives an empty
table; other columns of the input are dropped.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arborspark.llm.common import partitions, prepare, table, text_of

#: Pre-tokens joined on the map side, at most, and the characters of each: under 64 MB.
HOT_ENTRIES, HOT_CHARS = 1 << 18, 48
#: Hashes that several pre-tokens share, at most: at 10^10 of them about three pairs are to be expected.
CLASHES = 1 << 12
#: The space mark of the vocabulary, a fixed value.
MARK = "▁"

_models: dict[str, object] = {}


def model(path: str):
    if path not in _models:
        import sentencepiece

        _models[path] = sentencepiece.SentencePieceProcessor(model_file=path)
    return _models[path]


def boundaries_hold(path: str) -> bool:
    """Whether no piece has the mark behind another character."""
    sp = model(path)
    return not any(MARK in sp.id_to_piece(i).lstrip(MARK) for i in range(sp.get_piece_size()))


def pretokens(text: str) -> list[str]:
    """The text's pre-tokens, each without its first mark: the model puts one in front of any text."""
    if not text:
        return []
    parts = (" " + text.replace(MARK, " ")).split(" ")[1:]
    if "" not in parts:
        return parts
    out, gap = [], 0
    for part in parts[:-1]:
        if part:
            out.append(" " * gap + part)
            gap = 0
        else:
            gap += 1
    out.append(" " * gap + parts[-1])
    return out


def _distinct(df: DataFrame) -> DataFrame:
    """``pre_token, n``: every distinct pre-token of the corpus and how often it occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            for text in batch.column(1):
                seen.update(pretokens(text.as_py()))
                if len(seen) >= 1 << 18:
                    yield pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.string()), pa.array(seen.values(), pa.int64())], ["pre_token", "n"])
                    seen = Counter()
        yield pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.string()), pa.array(seen.values(), pa.int64())], ["pre_token", "n"])

    return df.mapInArrow(run, "pre_token string, n bigint").groupBy("pre_token").agg(F.sum("n").alias("n"))


def key_of(pre_token: str) -> int:
    """A 64-bit hash as a signed long."""
    from xxhash import xxh64_intdigest

    h = xxh64_intdigest(pre_token)
    return h - (1 << 64) if h >> 63 else h


def _pieces(distinct: DataFrame, path: str) -> DataFrame:
    """``pre_token, n, n_pieces``: the model is asked once for each distinct pre-token.

    The model puts a mark in front itself; a mark that stands alone is one piece.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = model(path).encode(batch.column(0).to_pylist(), num_threads=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([max(1, len(x)) for x in ids], pa.int64())], ["pre_token", "n", "n_pieces"])

    return distinct.mapInArrow(run, "pre_token string, n bigint, n_pieces bigint")


def with_keys(counts: DataFrame) -> DataFrame:
    """``pre_token, n, n_pieces, key``: keys are made when they are needed, not stored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = pa.array([key_of(p) for p in batch.column(0).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, keys], ["pre_token", "n", "n_pieces", "key"])

    return counts.select("pre_token", "n", "n_pieces").mapInArrow(run, "pre_token string, n bigint, n_pieces bigint, key bigint")


def clashing(counts: DataFrame) -> list[int]:
    """Keys on more than one pre-token, CLASHES + 1 at most. Nothing but the keys is moved."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        keys = np.sort(np.concatenate([np.empty(0, np.int64), *[b.column(0).to_numpy() for b in batches]]))
        yield pa.RecordBatch.from_arrays([pa.array(np.unique(keys[1:][keys[1:] == keys[:-1]]), pa.int64())], ["key"])

    moved = counts.select("key").repartition(partitions(counts.sparkSession), "key")
    return [r[0] for r in moved.mapInArrow(run, "key bigint").limit(CLASHES + 1).collect()]


def hot_rows(counts: DataFrame) -> DataFrame:
    """``pre_token, n_pieces`` of the most frequent pre-tokens, at most HOT_ENTRIES, and of those whose hashes clash.

    A cut-off frequency comes from a histogram with 16 bins for each doubling, a thousand
    rows at most; the pre-tokens at or above it are then filtered, not sorted.
    """
    short = counts.where(F.length("pre_token") <= HOT_CHARS)
    level = F.floor(F.log2("n") * 16).cast("int")
    bins = sorted(((r["level"], r["size"]) for r in short.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("size")).collect()), reverse=True)
    least, room = None, HOT_ENTRIES
    for at, size in bins:
        if size > room:
            break
        least, room = at, room - size
    hot = short.limit(0) if least is None else short.where(level >= least)
    keyed = counts if "key" in counts.columns else with_keys(counts)
    keys = clashing(keyed)
    clash = keyed.where(F.col("key").isin(keys)) if keys else counts.limit(0)
    return hot.select("pre_token", "n_pieces").unionByName(clash.select("pre_token", "n_pieces").limit(2 * CLASHES + 2))


def count_tokens(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 4096) -> DataFrame:
    """``id_col, n_bytes, n_tokens, over_limit`` of every document."""
    if not boundaries_hold(path):
        raise ValueError(f"a piece of {path} has a space mark behind another character: pre-tokens cannot be counted on their own")
    spark = df.sparkSession
    prepare(spark)
    kind = df.schema[id_col].dataType.simpleString()
    docs = df.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    counts = table(_pieces(_distinct(docs), path), "pre-token-pieces")
    rows = hot_rows(counts).toArrow()
    if rows.num_rows > HOT_ENTRIES + 2 * CLASHES:
        raise ValueError("too many pre-tokens share a hash")
    hot = spark.sparkContext.broadcast(dict(zip(*(c.to_pylist() for c in rows.columns), strict=True)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = hot.value.get
        out: tuple[list, ...] = ([], [], [], [], [], [])
        row = 0

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], names)

        types = [id_type, pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
        names = ["id", "row", "n_bytes", "n_hot", "key", "n"]
        for batch in batches:
            for id_, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                row += 1
                raw = text.as_py()
                total, rest = 0, []
                for p in pretokens(raw):
                    if (c := known(p)) is None:
                        rest.append(p)
                    else:
                        total += c
                tail = Counter(rest)
                for k, first in enumerate((id_, row, len(raw.encode()), total, None, None)):
                    out[k].append(first)
                    if k < 4:
                        out[k].extend([row if k == 1 else None] * len(tail))
                out[4].extend([key_of(p) for p in tail])
                out[5].extend(tail.values())
                if len(out[0]) >= 20_000:
                    yield flush()
                    out = ([], [], [], [], [], [])
        if out[0]:
            yield flush()

    id_type = pa.int64() if kind == "bigint" else pa.int32() if kind == "int" else pa.string()
    if kind not in ("bigint", "int"):
        docs = docs.withColumn("id", F.col("id").cast("string"))
        kind = "string"
    # A document is known by its partition and place in it, as ids may repeat or be null.
    parts = docs.mapInArrow(run, f"id {kind}, row bigint, n_bytes bigint, n_hot bigint, key bigint, n bigint")
    place = F.shiftleft(F.spark_partition_id().cast("bigint"), 36) + F.col("row")
    parts = table(parts.withColumn("row", place), "pre-token-frequencies")
    tail = (
        parts.where("key is not null")
        .select("row", "key", "n")
        .join(with_keys(counts).select("key", "n_pieces"), "key")
        .groupBy("row")
        .agg(F.sum(F.col("n") * F.col("n_pieces")).alias("n_tail"))
    )
    heads = parts.where("key is null").select("row", "id", "n_bytes", "n_hot")
    n = F.col("n_hot") + F.coalesce("n_tail", F.lit(0))
    return heads.join(tail, "row", "left").select(F.col("id").alias(id_col), "n_bytes", n.alias("n_tokens"), (n > limit).alias("over_limit"))
