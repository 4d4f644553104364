"""Near-duplicate groups by 64-bit SimHash and BK-trees.

Fingerprints are made in one map pass. Two of them that differ in at most 3 of 64 bits
agree on at least one of four 16-bit blocks, so each distinct fingerprint is sent to four
shards, one for each block value. A shard's BK-tree keys a node's children by their
integer Hamming distance to it; a search follows only edges within the radius. A shard
too large for one tree is dealt again by the same argument on the bits that are left, so
no link is lost and no bucket is capped; after the last level nine bits are left, so that
no shard can hold more than 512 fingerprints. A tree hands on a star for each of its local
components, not its pairs; stars are merged by alternating large and small stars.

The trees go where their queries are, with the shuffle, rather than to every executor:
a broadcast passes through the driver, and all trees together are the fingerprints of all
documents, which have no size bound and must not be gathered there.

Defined results: a null text counts as empty; texts without words have fingerprint 0 and
are linked like any other; copies share a fingerprint and so a component; null ids never
name a component unless it has no other id; repeated rows give repeated rows; an empty
table gives an empty table; other columns of the input are dropped by the query and kept
by :func:`deduplicate`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arborspark.llm.common import columns, fresh, prepare, table, text_of

RADIUS, SEED = 3, 42
#: Distinct fingerprints in one tree, at most, as long as bits are left to deal them by.
TREE_ENTRIES = 2048
#: Bits of the blocks at each level, four of them within the bits that are left: 64, 48, 36, 27, 21, 16, 12; 9 remain.
LEVELS = (16, 12, 9, 6, 5, 4, 3)


def shingle_hashes(text: str, k: int = 3) -> list[int]:
    """XXH64 of each run of k words, repeats included; fewer words: the whole sequence."""
    from xxhash import xxh64_intdigest

    words = text.encode().lower().split()  # bytes: the six ASCII white-space characters, A-Z only
    if not words:
        return []
    if len(words) < k:
        return [xxh64_intdigest(b" ".join(words), SEED)]
    return [xxh64_intdigest(b"%b %b %b" % w, SEED) for w in zip(words, words[1:], words[2:], strict=False)] if k == 3 else [xxh64_intdigest(b" ".join(words[i : i + k]), SEED) for i in range(len(words) - k + 1)]


#: Bit b of byte value v, and the place of each of the eight byte columns among 8 x 256 counters.
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
_COLUMN = (np.arange(8) * 256).astype(np.uint16)


def fingerprint(text: str, k: int = 3) -> int:
    """Bit i is 1 where more than half of the hashes have it; as a signed long."""
    hashes = shingle_hashes(text, k)
    ones = np.zeros((8, 8), np.int64)
    for at in range(0, len(hashes), 1 << 14):
        part = np.array(hashes[at : at + (1 << 14)], np.uint64)
        counts = np.bincount((part.view(np.uint8).reshape(-1, 8) + _COLUMN).ravel(), minlength=2048)
        ones += counts.reshape(8, 256) @ _BITS
    bits = 2 * ones.ravel() > len(hashes)
    return int(np.packbits(bits, bitorder="little").view(np.int64)[0])


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, fp, text_hash`` (64 bits as signed longs) of every row."""
    prepare(df.sparkSession)
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = pa.array([fingerprint(t.as_py()) for t in batch.column(1)], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), made, batch.column(2)], ["id", "fp", "text_hash"])

    text = text_of(text_col)
    return df.select(F.col(id_col).alias("id"), text.alias("text"), F.xxhash64(text).alias("text_hash")).mapInArrow(run, f"id {kind}, fp bigint, text_hash bigint")


class BKTree:
    """Children of a node by integer Hamming distance to it."""

    def __init__(self) -> None:
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def add(self, value: int) -> int:
        at, place = 0, len(self.values)
        self.values.append(value)
        self.children.append({})
        if place:
            while True:
                edges = self.children[at]
                d = (self.values[at] ^ value).bit_count()
                if d not in edges:
                    edges[d] = place
                    break
                at = edges[d]
        return place

    def within(self, value: int, radius: int = RADIUS) -> list[int]:
        """Places of all values within the radius."""
        found, ahead = [], [0] if self.values else []
        while ahead:
            at = ahead.pop()
            d = (self.values[at] ^ value).bit_count()
            if d <= radius:
                found.append(at)
            edges = self.children[at]
            if len(edges) <= 2 * radius + 1:
                ahead.extend([c for e, c in edges.items() if d - radius <= e <= d + radius])
            else:
                ahead.extend([edges[e] for e in range(d - radius, d + radius + 1) if e in edges])
        return found


def stars(values: list[int]) -> list[tuple[int, int]]:
    """(value, least value of its component) in one shard, for values that have a link."""
    tree, root = BKTree(), list(range(len(values)))

    def top(k: int) -> int:
        while root[k] != k:
            root[k] = k = root[root[k]]
        return k

    for k, v in enumerate(values):
        for other in tree.within(v & 0xFFFFFFFFFFFFFFFF):
            a, b = top(k), top(other)
            if a != b:
                root[max(a, b)] = min(a, b)
        tree.add(v & 0xFFFFFFFFFFFFFFFF)
    return [(v, values[r]) for k, v in enumerate(values) if (r := top(k)) != k]


def _dealt(points: DataFrame, width: int) -> DataFrame:
    """``key, fp, rest``: each point once for each block of its remaining bits."""
    blocks = F.explode(F.sequence(F.lit(0), F.lit(3))).alias("block")
    rows = points.select("key", "fp", "rest", blocks)
    value = F.expr(f"shiftrightunsigned(rest, block * {width}) & {(1 << width) - 1}L")
    low = F.expr(f"rest & (shiftleft(1L, block * {width}) - 1L)")
    high = F.expr(f"if((block + 1) * {width} >= 64, 0L, shiftleft(shiftrightunsigned(rest, (block + 1) * {width}), block * {width}))")
    return rows.select(F.concat_ws(".", "key", F.concat_ws(":", "block", value)).alias("key"), "fp", low.bitwiseOR(high).alias("rest"))


def links(points: DataFrame) -> DataFrame:
    """``a, b``: for distinct fingerprints ``fp``, links enough to join all that lie within the radius."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, key = [], None
        out: list[tuple[int, int]] = []
        for batch in batches:
            for k, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if k != key:
                    if len(held) > 1:
                        out += stars(held)
                    held, key = [], k
                held.append(v)
            if len(out) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], ["a", "b"])
                out = []
        if len(held) > 1:
            out += stars(held)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], ["a", "b"])

    spark = points.sparkSession
    at, found = points.select(F.lit("").alias("key"), "fp", F.col("fp").alias("rest")), []
    for level, width in enumerate(LEVELS):
        shards = _dealt(at, width)
        sizes = table(shards.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), f"simhash-shards-{level}")
        large = sizes.where(F.col("n") > TREE_ENTRIES).select("key")
        more = level + 1 < len(LEVELS) and bool(large.take(1))
        fit = sizes.where(F.col("n") <= TREE_ENTRIES) if more else sizes
        ready = shards.join(fit.select("key"), "key", "left_semi").select("key", "fp")
        n = int(spark.conf.get("spark.sql.shuffle.partitions"))
        found.append(ready.repartition(n, "key").sortWithinPartitions("key", "fp").mapInArrow(run, "a bigint, b bigint"))
        if not more:
            break
        at = shards.join(large, "key", "left_semi")
    out = found[0]
    for x in found[1:]:
        out = out.unionByName(x)
    return out.distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """``node, root``: the least node of each linked node's component, by large and small stars."""
    e = table(edges.where("a <> b").distinct(), "star-edges")
    if e.isEmpty():
        return e.select(F.col("a").alias("node"), F.col("b").alias("root"))
    state = None
    for _ in range(rounds):
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).union(e.select("b", "a"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = table(large, "star-large")
        # Each edge now leads from a node to a smaller one; hang a node's smaller neighbours under the least.
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        e = large.join(least, "a").select(F.explode(F.array(F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("x")).select("x.a", "x.b").where("a <> b").distinct()
        e = table(e, "star-small")
        now = e.agg(F.count(F.lit(1)), F.sum(F.hash("a", "b").cast("bigint"))).first()
        if tuple(now) == state:
            break
        state = tuple(now)
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return e.select(F.col("a").alias("node"), F.col("b").alias("root"))


def _labelled(df: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """``id, fp`` of every row, and ``label_fp, root, component_id`` of every distinct fingerprint."""
    prints = table(fingerprints(df, id_col, text_col), "simhash-prints")
    points = table(prints.groupBy("fp").agg(F.min("id").alias("first_id")), "simhash-points")
    roots = components(links(points.select("fp")))
    named = points.join(roots, points["fp"] == roots["node"], "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    named = table(named, "simhash-roots")
    ids = named.groupBy("root").agg(F.min("first_id").alias("component_id"))
    return prints, table(named.join(ids, "root").select(F.col("fp").alias("label_fp"), "root", "component_id"), "simhash-labels")


def near_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, fingerprint, component_id`` of every row."""
    prints, labels = _labelled(df, id_col, text_col)
    out = prints.join(labels, F.col("fp") == F.col("label_fp"), "left")
    return out.select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def deduplicate(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component, with all columns of ``df``: the row of the least id.

    Where that id stands on several rows of the component, the one of the least text hash
    stays. A component without any id keeps a row of its least fingerprint. An id that
    stands on texts of several components keeps a row in each that it names.
    """
    prints, labels = _labelled(df, id_col, text_col)
    (key,) = fresh(df, "row_key")
    # What tells the rows of a component apart, in order of preference; copies are folded before the join.
    rank = F.struct(F.col("id").isNull().alias("bare"), F.col("id"), F.when(F.col("id").isNull(), F.col("fp")).alias("fp"), F.col("text_hash"))
    best = prints.groupBy("fp").agg(F.min(rank).alias("best")).join(labels, F.col("fp") == F.col("label_fp"))
    keep = best.groupBy("root").agg(F.min("best").alias("best")).select(F.struct("best.id", "best.text_hash").alias(key)).distinct()
    keyed = df.withColumn(key, F.struct(F.col(id_col).alias("id"), F.xxhash64(text_of(text_col)).alias("text_hash")))
    return keyed.join(keep, key, "left_semi").dropDuplicates([key]).select(columns(df.columns))
