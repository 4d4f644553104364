"""Draws by digest, summed by group: each cluster's digests are made once for all groups.

A draw's number for a cluster is the first 32 bits of SHA-256 of ``seed:draw:cluster``, so
that any engine draws the same. Signs need one bit of it: Spark's own digest, compiled, makes
them in blocks of draws. Numbers are made for many draws and clusters at once, a step of the
digest for all of them by one array operation.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from arborspark.sources.work import importable

#: Constants of SHA-256: the first bits of the fractions of the cube roots, and of the square roots, of the first primes.
_PRIMES = [p for p in range(2, 312) if all(p % q for q in range(2, int(p**0.5) + 1))]


def _root(p: int, power: int) -> int:
    """First 32 bits of the fraction of the root."""
    n, low, high = p << (32 * power), 0, p << 32
    while high - low > 1:
        mid = (low + high) // 2
        low, high = (mid, high) if mid**power <= n else (low, mid)
    return low & 0xFFFFFFFF


_K = [_root(p, 3) for p in _PRIMES]
_H = [_root(p, 2) for p in _PRIMES[:8]]
#: Bytes of a text that fits one block, digests made at once, groups whose sums a task holds, tasks at most, draws whose signs are bits of one row.
ONE_BLOCK, AT_ONCE, HELD, TASKS, BITS = 55, 60_000, 256, 96, 16


def _turned(x: np.ndarray, turns: tuple[int, ...], shift: int, out: np.ndarray, spare: np.ndarray) -> np.ndarray:
    """Exclusive or of ``x`` turned right by each of ``turns``, and shifted by ``shift`` if that is not 0."""
    np.right_shift(x, np.uint32(turns[0]), out=out)
    for k in turns[1:]:
        np.bitwise_xor(out, np.right_shift(x, np.uint32(k), out=spare), out=out)
    for k in turns:
        np.bitwise_xor(out, np.left_shift(x, np.uint32(32 - k), out=spare), out=out)
    if shift:
        np.bitwise_xor(out, np.right_shift(x, np.uint32(shift), out=spare), out=out)
    return out


def _turned_int(x: int, turns: tuple[int, ...], shift: int) -> int:
    out = x >> shift
    for k in turns:
        out ^= (x >> k) | (x << (32 - k)) & 0xFFFFFFFF
    return out


def first_words(words: list[int | np.ndarray], n: int) -> np.ndarray:
    """First word of the digest of ``n`` blocks; each of their 16 words is one number for all, or an array that may be overwritten."""
    a, b, c, d, e, f, g, h = (np.full(n, x, np.uint32) for x in _H)
    t, u, spare = (np.empty(n, np.uint32) for _ in range(3))
    between = np.bitwise_xor(b, c)
    words = list(words)
    for i in range(64):
        if i >= 16:
            # The next word, in the place of the one 16 before.
            fixed, own = 0, words[i % 16]
            if isinstance(own, int):
                fixed, own = own, None
            for x, turns, shift in ((words[(i - 15) % 16], (7, 18), 3), (words[(i - 7) % 16], (), 0), (words[(i - 2) % 16], (17, 19), 10)):
                if isinstance(x, int):
                    fixed += _turned_int(x, turns, shift) if turns else x
                else:
                    x = _turned(x, turns, shift, t, spare) if turns else x
                    own = x.copy() if own is None else np.add(own, x, out=own)
            fixed &= 0xFFFFFFFF
            words[i % 16] = fixed if own is None else np.add(own, np.uint32(fixed), out=own) if fixed else own
        np.add(h, _turned(e, (6, 11, 25), 0, t, spare), out=h)
        np.bitwise_and(np.bitwise_xor(f, g, out=t), e, out=t)
        np.add(h, np.bitwise_xor(t, g, out=t), out=h)
        w = words[i % 16]
        if isinstance(w, int):
            np.add(h, np.uint32((w + _K[i]) & 0xFFFFFFFF), out=h)
        else:
            np.add(h, np.add(w, np.uint32(_K[i]), out=t), out=h)
        np.add(d, h, out=d)
        np.add(h, _turned(a, (2, 13, 22), 0, t, spare), out=h)
        np.bitwise_and(np.bitwise_xor(a, b, out=u), between, out=t)
        np.add(h, np.bitwise_xor(t, b, out=t), out=h)
        between, u = u, between
        a, b, c, d, e, f, g, h = h, a, b, c, d, e, f, g
    return np.add(a, np.uint32(_H[0]), out=a)


def _as_words(texts: list[bytes]) -> np.ndarray:
    """The 16 words of each block of 64 bytes."""
    return np.frombuffer(b"".join(x.ljust(64, b"\0") for x in texts), ">u4").reshape(len(texts), 16).astype(np.uint32)


def numbers(heads: list[bytes], tails: list[bytes]) -> Iterator[tuple[int, np.ndarray]]:
    """Of ``tail`` by ``head``: the first 32 bits of the digests of ``head + tail``, some tails at a time with the place of the first of them.

    The tails are of one length. Texts of all lengths that fit a block are worked on together, as short arrays cost most.
    """
    sizes = [len(x) + len(tails[0]) for x in heads]
    short = [k for k, size in enumerate(sizes) if size <= ONE_BLOCK]
    begins = sorted({len(heads[k]) for k in short})
    own = _as_words([heads[k] for k in short]) if short else None
    places = {begin: [i for i, k in enumerate(short) if len(heads[k]) == begin] for begin in begins}
    bits = np.array([sizes[k] * 8 for k in short], np.uint32)
    step = max(1, AT_ONCE // len(heads))
    for at in range(0, len(tails), step):
        some = tails[at : at + step]
        out = np.empty((len(some), len(heads)), np.uint32)
        if short:
            block = np.repeat(own[None], len(some), axis=0)
            for begin in begins:
                block[:, places[begin]] |= _as_words([b"\0" * begin + y + b"\x80" for y in some])[:, None]
            words: list[int | np.ndarray] = [np.ascontiguousarray(block[:, :, k]).ravel() if block[:, :, k].any() else 0 for k in range(15)]
            out[:, short] = first_words([*words, np.tile(bits, len(some))], len(some) * len(short)).reshape(len(some), len(short))
        for k in range(len(heads)) if len(short) < len(heads) else ():
            if sizes[k] > ONE_BLOCK:
                out[:, k] = [int.from_bytes(hashlib.sha256(heads[k] + y).digest()[:4], "big") for y in some]
        yield at, out


class _Sums:
    """Sums by group in a task: of ``HELD`` groups at most, which ``told`` gives as a part to begin anew."""

    def __init__(self, group: list[str], draws: int, counts: bool):
        from pyspark import TaskContext

        self.group, self.counts, self.held, self.part = group, counts, {}, TaskContext.get().partitionId() << 32
        self.s, self.n, self.known = np.zeros((HELD, draws + 1)), np.zeros((HELD, draws + 1 if counts else 1)), np.zeros(HELD, bool)

    def full(self, key: tuple) -> bool:
        return key not in self.held and len(self.held) == HELD

    def place(self, key: tuple) -> int:
        return self.held.setdefault(key, len(self.held))

    def add(self, of: np.ndarray, at: np.ndarray, own: np.ndarray, many: np.ndarray, clusters: int, weights: Iterable[tuple[slice, np.ndarray]]) -> None:
        """Adds up rows: of the cluster ``of``, the group held at ``at``; ``weights`` are those of some clusters at a time under all draws."""
        used = len(self.held)
        mine, number = np.zeros((used, clusters)), np.zeros((used, clusters))
        np.add.at(mine, (at, of), np.nan_to_num(own))
        np.add.at(number, (at, of), many)
        self.known[at[~np.isnan(own)]] = True
        self.s[:used, 0] += mine.sum(axis=1)
        self.n[:used, 0] += number.sum(axis=1)
        for here, w in weights:
            self.s[:used, 1:] += mine[:, here] @ w
            if self.counts:
                self.n[:used, 1:] += number[:, here] @ w

    def told(self) -> Iterator:
        import pandas as pd

        for key, k in self.held.items():
            yield pd.DataFrame([(*key, self.part, self.s[k].tobytes(), self.n[k].tobytes(), bool(self.known[k]))], columns=[*self.group, "part", "s", "n", "known"])
        self.part += 1
        self.held.clear()
        self.s[:], self.n[:], self.known[:] = 0, 0, False


def _dealt(rows: DataFrame, group: list[str], cluster: str, value: str) -> tuple[DataFrame, str]:
    """``group, __tail, s, n`` of each group and cluster, a cluster's rows in one task; and the columns of a part."""
    sums = rows.groupBy(*group, cluster).agg(F.sum(value).cast("double").alias("s"), F.count(F.lit(1)).alias("n")).dropna(subset=group)
    named = sums.select(*group, F.coalesce(F.concat(F.lit(":"), F.col(cluster).cast("string")), F.lit("")).alias("__tail"), "s", "n")
    tasks = min(TASKS, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    kinds = ", ".join(f"`{g}` {rows.schema[g].dataType.simpleString()}" for g in group)
    return importable(named).repartition(tasks, "__tail"), f"{kinds}, part bigint, s binary, n binary, known boolean"


def signed(rows: DataFrame, group: list[str], cluster: str, value: str, draws: int, seed: int) -> DataFrame:
    """``drawn`` with the weight 1 where a digest begins with a digit below 8, else -1; ``n`` holds the count without a draw.

    The first row of a cluster meets all blocks of draws, and a block's signs are the bits of one number.
    """
    dealt, kinds = _dealt(rows, group, cluster, value)
    number = F.row_number().over(Window.partitionBy("__tail").orderBy(*group))
    own = dealt.select("*", (number == 1).alias("__first")).withColumn("__row", F.monotonically_increasing_id())
    n_blocks = -(-draws // BITS)
    heads = [F.concat(F.lit(f"{seed}:"), (F.col("id") * BITS + k + 1).cast("string")).alias(f"__head{k}") for k in range(BITS)]
    blocks = rows.sparkSession.range(0, n_blocks, 1, 1).select(F.col("id").cast("int").alias("__block"), *heads)
    turned = [F.when(F.sha2(F.concat(f"__head{k}", "__tail"), 256) >= "8", 1 << k).otherwise(0) for k in range(BITS)]
    bits = F.when(F.col("__first"), reduce(lambda a, b: a.bitwiseOR(b), turned)).otherwise(0)
    met = own.join(F.broadcast(blocks), F.col("__first") | (F.col("__block") == 0))

    def added(batches):
        sums = _Sums(group, draws, counts=False)

        def put(some: list[tuple], signs: np.ndarray):
            """Adds up ``cluster, group, s, n``, the clusters being rows of ``signs``."""
            begin = 0
            for k in range(len(some) + 1):
                if k == len(some) or sums.full(some[k][1]):
                    if k > begin:
                        low, high = some[begin][0], some[k - 1][0] + 1
                        w = 1.0 - 2.0 * np.unpackbits(signs[low:high].view(np.uint8), axis=1, count=draws, bitorder="little")
                        of, at, own, many = (np.array(x) for x in zip(*[(o - low, sums.held[key], s, n) for o, key, s, n in some[begin:k]], strict=True))
                        sums.add(of, at, own.astype(np.float64), many, high - low, [(slice(None), w)])
                    begin = k
                    if k < len(some):
                        yield from sums.told()
                if k < len(some):
                    sums.place(some[k][1])

        # Of the last cluster: the number of its first row, its signs so far, and that row, until all signs are there.
        last, signs, waiting = -1, np.zeros((1, n_blocks), "<u2"), []
        for pdf in batches:
            if not len(pdf):
                continue
            first, row, block = pdf["__first"].to_numpy(bool), pdf["__row"].to_numpy(), pdf["__block"].to_numpy()
            begun = np.diff(row[first], prepend=last) != 0
            of = np.zeros(len(pdf), np.int64)
            of[np.flatnonzero(first)[begun]] = 1
            of = np.cumsum(of)
            signs = np.concatenate([signs[-1:], np.zeros((of[-1], n_blocks), "<u2")])
            signs[of[first], block[first]] = pdf["__bits"].to_numpy()[first]
            last = row[first][-1] if first.any() else last
            head = block == 0
            found = pdf[head]
            ready = [*waiting, *zip(of[head].tolist(), zip(*[found[g].tolist() for g in group], strict=True), found["s"].tolist(), found["n"].tolist(), strict=True)]
            # Other rows of a cluster come after all blocks of its first one.
            waiting = [(0, *ready.pop()[1:])] if ready and ready[-1][0] == of[-1] and first[of == of[-1]].all() else []
            yield from put(ready, signs)
        yield from put(waiting, signs[-1:])
        yield from sums.told()

    return met.select(*group, "s", "n", "__first", "__row", "__block", bits.alias("__bits")).mapInPandas(added, kinds)


def drawn(rows: DataFrame, group: list[str], cluster: str, value: str, weigh: Callable[[np.ndarray], np.ndarray], draws: int, seed: int, counts: bool) -> DataFrame:
    """``group, part, s, n, known``: sums of ``value`` and counts of rows under each draw, as parts to be added up.

    ``s`` and ``n`` hold ``draws + 1`` doubles, of which the first is the sum without a draw
    (``n`` holds only that one, unless ``counts``). ``weigh`` makes weights of the draws' numbers.
    """
    dealt, kinds = _dealt(rows, group, cluster, value)
    heads = [f"{seed}:{k}".encode() for k in range(1, draws + 1)]

    def added(batches):
        sums = _Sums(group, draws, counts)

        def add(tails: list[bytes], of: list[int], at: list[int], own: np.ndarray, many: np.ndarray):
            weights = ((slice(first, first + len(x)), weigh(x).astype(np.float64)) for first, x in numbers(heads, tails))
            sums.add(np.array(of), np.array(at), own, many, len(tails), weights)

        for pdf in batches:
            keys = list(zip(*[pdf[g].tolist() for g in group], strict=True))
            texts, own, many = [x.encode() for x in pdf["__tail"]], pdf["s"].to_numpy(np.float64), pdf["n"].to_numpy(np.float64)
            begin, tails, of, at = 0, [], [], []
            for k, (key, text) in enumerate(zip(keys, texts, strict=True)):
                full = sums.full(key)
                if tails and (full or (text != tails[-1] and (len(text) != len(tails[0]) or len(tails) == 1024))):
                    add(tails, of, at, own[begin:k], many[begin:k])
                    begin, tails, of, at = k, [], [], []
                if full:
                    yield from sums.told()
                if not tails or text != tails[-1]:
                    tails.append(text)
                of.append(len(tails) - 1)
                at.append(sums.place(key))
            if tails:
                add(tails, of, at, own[begin:], many[begin:])
        yield from sums.told()

    return dealt.sortWithinPartitions(F.length("__tail"), "__tail", *group).mapInPandas(added, kinds)


def summed(parts: DataFrame, group: list[str], made: Callable[[np.ndarray, np.ndarray], tuple], kinds: str) -> DataFrame:
    """``group`` and what ``made(s, n)`` gives of the sums of the parts, which are added in order; a group without a known value gives nulls for doubles."""
    import pandas as pd

    schema = parts.schema

    def one(pdf):
        pdf = pdf.sort_values("part")
        s, n = (np.sum([np.frombuffer(x) for x in pdf[c]], axis=0) for c in ("s", "n"))
        if not pdf["known"].any():
            s = np.full(len(s), np.nan)
        return pd.DataFrame([(*pdf[group].iloc[0].tolist(), *made(s, n))], columns=[*group, *[x.split()[0] for x in kinds.split(", ")]])

    return parts.groupBy(*group).applyInPandas(one, ", ".join(f"`{g}` {schema[g].dataType.simpleString()}" for g in group) + f", {kinds}")
