"""Canonical exact fingerprints of whole texts.

A text is brought to a canonical form (NFKC, case folding, white space folded to single
blanks) and named by a 128-bit XXH3 of it. Inside buckets of equal digests the canonical
bytes themselves are compared, edited texts by their SHA-256; should different bytes ever
share a digest, each variant gets a fingerprint of its own, numbered in the order of their
SHA-256.

Documents meet their neighbours in a range partitioning by id: a task walks its range in
order, and the first row of each range is joined to the last row of the range before it by
the ranges' numbers. No id is hot: rows of one id are spread by their texts' hash, and rows
that are equal in both by their place in the input.

Defined results: a null text counts as empty; texts of white space only are equal to the
empty text; documents follow each other by descending id, rows of the same id by
descending XXH64 of their text, and a null id comes last; a single document is its own
next one; an empty table gives an empty table; other columns are dropped.
"""

from __future__ import annotations

import hashlib
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from arborspark.llm.common import partitions, prepare, table, text_of

#: Bits of the table that tells which digests stand on more than one row: 2 MB, whatever the corpus.
FILTER_BITS = 24


def canonical(text: str) -> bytes:
    folded = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text).casefold())
    return " ".join(folded.split()).encode("utf-8", "surrogatepass")


def digest(canon: bytes) -> str:
    import xxhash

    return xxhash.xxh3_128_hexdigest(canon)


def _place(name: bytes) -> int:
    return int.from_bytes(name[:4]) >> (32 - FILTER_BITS)


def group_exactly(docs: DataFrame, digests: DataFrame) -> DataFrame:
    """``digest, canon_sha, variant`` for digests that different canonical bytes share; no rows, as a rule.

    ``docs`` has the texts, ``digests`` the ``digest, canon_sha`` of every text and of every
    other form to be told apart. Digests that stand on several rows are marked in a bit
    table of fixed size; only rows it lets through are compared, texts by their bytes: each
    distinct one of a batch is moved once, so that a large group of copies becomes a row
    for each batch.
    """
    spark = docs.sparkSession
    size = 1 << FILTER_BITS
    place = F.expr(f"cast(conv(hex(substring(digest, 1, 4)), 16, 10) as bigint) >> {32 - FILTER_BITS}")
    twice = digests.groupBy("digest").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    # 2^24 places as 2^18 words of 64 bits: what comes to the driver has that bound.
    words = twice.select(place.alias("place")).groupBy((F.col("place") / 64).cast("bigint").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(place % 64 as int))")).alias("bits"))
    marks = np.zeros(size // 64, np.uint64)
    got = words.toArrow()
    marks[got["word"].to_numpy()] = got["bits"].to_numpy().view(np.uint64)
    seen = spark.sparkContext.broadcast(marks)

    def marked(name: bytes) -> bool:
        at = _place(name)
        return bool(int(seen.value[at >> 6]) >> (at & 63) & 1)

    def bytes_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: dict[tuple[bytes, bytes], None] = {}
            for text in batch.column(0):
                name = bytes.fromhex(digest(canon := canonical(text.as_py())))
                if marked(name):
                    rows[name, canon] = None
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.binary()) for k in range(2)], ["digest", "canon"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, first, shown, out = None, b"", False, []
        for batch in batches:
            for name, canon in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                raw = canon.as_py()
                if name != last:
                    last, first, shown = name, raw, False
                elif raw != first:
                    if not shown:
                        out.append((name, hashlib.sha256(first).digest()))
                        shown = True
                    out.append((name, hashlib.sha256(raw).digest()))
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], pa.binary()) for k in range(2)], ["digest", "canon_sha"])

    def shas_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = pa.array([marked(name.as_py()) for name in batch.column(0)], pa.bool_())
            yield batch.filter(keep)

    n = partitions(spark)
    moved = docs.select("text").mapInArrow(bytes_of, "digest binary, canon binary").repartition(n, "digest").sortWithinPartitions("digest")
    clash = moved.mapInArrow(compare, "digest binary, canon_sha binary")
    shas = digests.select("digest", "canon_sha").mapInArrow(shas_of, "digest binary, canon_sha binary").distinct()
    shared = shas.groupBy("digest").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    clash = clash.unionByName(shas.join(shared.select("digest"), "digest", "left_semi")).distinct()
    return clash.withColumn("variant", F.row_number().over(Window.partitionBy("digest").orderBy("canon_sha")))


#: What is made for each row, with the Arrow type and the SQL type of each.
MADE = [("n_chars", pa.int64(), "bigint"), ("edited_sha", pa.binary(), "binary"), *[(n, pa.binary(), "binary") for n in ("digest", "edited_digest", "canon_sha", "edited_canon_sha")], ("near_edited", pa.float64(), "double"), ("near_next", pa.float64(), "double")]
#: A row of a range: its own result, or its first text, which waits for the row before, or its last text.
DONE, FIRST, LAST = 0, 1, 2


def made_from(text: str, after: str, name: Callable[[bytes], str]) -> tuple:
    """The columns of a text that ``after`` follows."""
    half = len(text) // 2
    edited = text[: len(text) - half] + after[:half]
    c, ce, ca = canonical(text), canonical(edited), canonical(after)
    sha = lambda b: hashlib.sha256(b).digest()
    return len(text), sha(edited.encode("utf-8", "surrogatepass")), bytes.fromhex(name(c)), bytes.fromhex(name(ce)), sha(c), sha(ce), float(c == ce), float(c == ca)


def with_next(docs: DataFrame, per_range: int) -> DataFrame:
    """``id`` and the columns of ``MADE`` for each row of ``docs(id, text)``, seen with the row that follows it.

    There are about ``per_range`` rows in a range, but at most 32 ranges for each shuffle
    partition of the session: a range is walked as a stream, so it may be of any size.
    """
    spark, id_type = docs.sparkSession, docs.schema["id"].dataType.simpleString()
    n = partitions(spark)
    n = max(n, min(32 * n, -(-docs.count() // per_range)))
    order = [F.col("id").asc_nulls_first(), F.col("mark").asc(), F.col("place").asc()]
    keyed = docs.select("id", "text", F.xxhash64("text").alias("mark"), F.monotonically_increasing_id().alias("place"))
    ranges = keyed.repartitionByRange(n, *order).sortWithinPartitions(*order).select("id", "text")
    names = ["id", "part", "edge", "text", *[m[0] for m in MADE]]
    schema = f"id {id_type}, part int, edge int, text string, " + ", ".join(f"{m[0]} {m[2]}" for m in MADE)
    nothing = (None,) * len(MADE)

    def batch_of(ids: pa.Array, rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int32(), pa.int32(), pa.string(), *[m[1] for m in MADE]]
        return pa.RecordBatch.from_arrays([ids, *[pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)]], names)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, before, ids = TaskContext.get().partitionId(), None, None
        for batch in batches:
            rows, ids = [], batch.column(0)
            for value in batch.column(1):
                text = value.as_py()
                rows.append((part, FIRST, text, *nothing) if before is None else (part, DONE, None, *made_from(text, before, digest)))
                before = text
            if rows:
                yield batch_of(ids, rows)
        if before is not None:
            yield batch_of(pa.nulls(1, ids.type), [(part, LAST, before, *nothing)])

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(0, DONE, None, *made_from(t.as_py(), a.as_py(), digest)) for t, a in zip(batch.column(1), batch.column(2), strict=True)]
            yield batch_of(batch.column(0), rows)

    made = table(ranges.mapInArrow(walk, schema), "fingerprints")
    firsts, lasts = made.where(F.col("edge") == FIRST), made.where(F.col("edge") == LAST)
    filled = sorted(r[0] for r in firsts.select("part").collect())  # a number for each range
    chain = spark.createDataFrame([(p, filled[k - 1]) for k, p in enumerate(filled)], "part int, before int")
    edges = firsts.join(chain, "part").join(lasts.select(F.col("part").alias("before"), F.col("text").alias("after")), "before")
    ends = table(edges.select("id", "text", "after").mapInArrow(finish, schema), "fingerprint-edges")
    return made.where(F.col("edge") == DONE).unionByName(ends).select("id", *[m[0] for m in MADE])


def fingerprint_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", per_range: int = 1 << 14) -> DataFrame:
    """Fingerprints of every text and of its edited form, and how like its fingerprint is to its own edit's and the next document's."""
    prepare(df.sparkSession)
    docs = df.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    made = with_next(docs, per_range)
    both = made.select("digest", "canon_sha").unionByName(made.select(F.col("edited_digest").alias("digest"), F.col("edited_canon_sha").alias("canon_sha")))
    clash = table(group_exactly(docs, both), "fingerprint-clashes")
    shown = lambda c: F.lower(F.hex(c))
    out = made.withColumns({"fingerprint": shown("digest"), "edited_fingerprint": shown("edited_digest")})
    if not clash.isEmpty():
        for name, key, sha in (("fingerprint", "digest", "canon_sha"), ("edited_fingerprint", "edited_digest", "edited_canon_sha")):
            side = clash.select(F.col("digest").alias("_d"), F.col("canon_sha").alias("_s"), "variant")
            out = out.join(side, (F.col(key) == F.col("_d")) & (F.col(sha) == F.col("_s")), "left").withColumn(name, F.concat_ws("-", name, F.col("variant").cast("string"))).drop("_d", "_s", "variant")
    return out.select(F.col("id").alias(id_col), "n_chars", shown("edited_sha").alias("edited_sha256"), "fingerprint", "edited_fingerprint", "near_edited", "near_next")
