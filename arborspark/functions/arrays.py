"""Folds over arrays whose results are arrays.

A fold that appends to an array copies it at every step. These work in blocks of about the
root of the array's length, so that n steps copy about n times that root.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once: an array of one binds its element."""
    return F.transform(F.array(value), body)[0]


def _empty(kind: str) -> Column:
    return F.expr(f"cast(array() as array<{kind}>)")


def _in_blocks(v: Column, body: Callable[[Column, Callable[[Column], Column]], Column], kind: str) -> Column:
    """``body(blocks, places)``: the numbers of the blocks and the places in one of them."""
    n = F.size(v)

    def sized(w: Column) -> Column:
        return body(F.sequence(F.lit(0), ((n - 1) / w).cast("int")), lambda b: F.sequence(b * w, F.least(n, (b + 1) * w) - 1))

    return F.when(n == 0, _empty(kind)).otherwise(let(F.ceil(F.sqrt(F.greatest(n, F.lit(1)))).cast("int"), sized))


def running(values: Column, combine: Callable[[Column, Column], Column], zero: int, kind: str = "int") -> Column:
    """The running sums (or maxima, minima): ``combine`` is associative, ``zero`` its neutral value."""
    start = F.lit(zero).cast(kind)

    def made(v: Column) -> Column:
        def body(blocks: Column, places: Callable[[Column], Column]) -> Column:
            totals = F.transform(blocks, lambda b: F.aggregate(places(b), start, lambda acc, i: combine(acc, F.get(v, i))))
            before = F.struct(start.alias("acc"), _empty(kind).alias("out"))
            starts = F.aggregate(totals, before, lambda a, x: F.struct(combine(a["acc"], x).alias("acc"), F.array_append(a["out"], a["acc"]).alias("out")), lambda a: a["out"])

            def block(first: Column, b: Column) -> Column:
                step = lambda a, i: let(combine(a["acc"], F.get(v, i)), lambda now: F.struct(now.alias("acc"), F.array_append(a["out"], now).alias("out")))
                return F.aggregate(places(b), F.struct(first.alias("acc"), _empty(kind).alias("out")), step, lambda a: a["out"])

            return F.flatten(F.transform(starts, block))

        return _in_blocks(v, body, kind)

    return let(values, made)


def scan(values: Column, state: Column, step: Callable[[Column, Column], tuple[Column, Column]], kind: str, look: Callable[[Column, Column], Column] = lambda at, x: x) -> Column:
    """A row of the type ``kind`` for each value: ``step(state, look(state, value))`` gives the next state and the row.

    What ``look`` makes of a value is worked out once.
    """

    def made(v: Column) -> Column:
        def body(blocks: Column, places: Callable[[Column], Column]) -> Column:
            def one(a: Column, i: Column) -> Column:
                def moved(x: Column) -> Column:
                    following, row = step(a["state"], x)
                    return F.struct(following.alias("state"), F.array_append(a["out"], row).alias("out"))

                return let(look(a["state"], F.get(v, i)), moved)

            def block(acc: Column, b: Column) -> Column:
                inner = F.aggregate(places(b), F.struct(acc["state"].alias("state"), _empty(kind).alias("out")), one)
                return let(inner, lambda r: F.struct(r["state"].alias("state"), F.array_append(acc["out"], r["out"]).alias("out")))

            return F.flatten(F.aggregate(blocks, F.struct(state.alias("state"), _empty(f"array<{kind}>").alias("out")), block, lambda acc: acc["out"]))

        return _in_blocks(v, body, kind)

    return let(values, made)
