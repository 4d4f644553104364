"""Match spans of regular expressions in code points, in Spark functions only.

Folds that append to an array copy it at every step, so positions are not folded over all
matches of a text: running values are made in blocks of about the root of their number,
each from its own start (:func:`running`).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Marks put around matches; in the text itself they are taken for another control character.
OPEN, SHUT, OTHER = "\x01", "\x02", "\x03"
ITEM = "struct<s:int,e:int,t:string,before:string,after:string>"
#: Characters before a match that it is given.
BEFORE = 32
FAR = 2**31 - 1


def none() -> Column:
    return F.expr(f"cast(array() as array<{ITEM}>)")


def literal(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once: an array of one binds its element."""
    return F.transform(F.array(value), body)[0]


def running(values: Column, combine: Callable[[Column, Column], Column], zero: int) -> Column:
    """The running sums (or maxima, minima) of an array of ints: ``combine`` is associative, ``zero`` its neutral value."""
    empty = F.expr("cast(array() as array<int>)")

    def made(v: Column) -> Column:
        n = F.size(v)

        def in_blocks(w: Column) -> Column:
            blocks = F.sequence(F.lit(0), ((n - 1) / w).cast("int"))
            places = lambda b: F.sequence(b * w, F.least(n, (b + 1) * w) - 1)
            total = F.transform(blocks, lambda b: F.aggregate(places(b), F.lit(zero), lambda acc, i: combine(acc, F.get(v, i))))
            first = F.struct(F.lit(zero).alias("acc"), empty.alias("out"))
            starts = F.aggregate(total, first, lambda a, x: F.struct(combine(a["acc"], x).alias("acc"), F.array_append(a["out"], a["acc"]).alias("out")), lambda a: a["out"])

            def block(start: Column, b: Column) -> Column:
                def step(a: Column, i: Column) -> Column:
                    now = combine(a["acc"], F.get(v, i))
                    return F.struct(now.alias("acc"), F.array_append(a["out"], now).alias("out"))

                return F.aggregate(places(b), F.struct(start.alias("acc"), empty.alias("out")), step, lambda a: a["out"])

            return F.flatten(F.transform(starts, block))

        return F.when(n == 0, empty).otherwise(let(F.ceil(F.sqrt(F.greatest(n, F.lit(1)))).cast("int"), in_blocks))

    return let(values, made)


def matches(text: Column, pattern: str, likely: Column | None = None) -> Column:
    """``array<struct<s, e, t, before, after>>``: start, end and text of the leftmost non-overlapping matches.

    ``before`` has the characters between the last match and this one, at most 32, and
    ``after`` the one behind it, unless the next match begins there. The text is cut at the
    matches and lengths are added up, as positions that Spark's own functions give count
    UTF-16 units. Texts that fail ``likely``, a cheaper necessary condition, or have no
    match are not cut.
    """
    plain = F.translate(text, OPEN + SHUT, OTHER + OTHER)
    cut = F.split(F.regexp_replace(plain, F.lit(pattern), F.lit(f"{OPEN}$0{SHUT}")), f"[{OPEN}{SHUT}]", -1)

    def placed(p: Column) -> Column:
        ends = running(F.transform(p, lambda x: F.length(x)), lambda a, b: a + b, 0)
        item = lambda e: lambda i: F.struct(F.get(e, i - 1).alias("s"), F.get(e, i).alias("e"), F.get(p, i).alias("t"), F.right(F.get(p, i - 1), F.lit(BEFORE)).alias("before"), F.left(F.get(p, i + 1), F.lit(1)).alias("after"))
        return F.when(F.size(p) > 2, let(ends, lambda e: F.transform(F.sequence(F.lit(1), F.size(p) - 2, F.lit(2)), item(e)))).otherwise(none())

    found = text.rlike(pattern) if likely is None else likely & text.rlike(pattern)
    return F.when(found, let(cut, placed)).otherwise(none())


def labelled(found: Column, kind: int) -> Column:
    """The spans as ``struct<s, k, e>``, which sorts by start and then kind."""
    return F.transform(found, lambda m: F.struct(m["s"].alias("s"), F.lit(kind).alias("k"), m["e"].alias("e")))


def overlapping(items: Column, base: Column) -> Column:
    """For each of ``items``, in their order, whether it overlaps one of ``base`` (structs with ``s`` and ``e``).

    All are put in order of their starts; an item overlaps if a base span that began no later
    reaches over its start, or the next one to begin does so before its end.
    """
    event = lambda x, item, i: F.struct(x["s"].alias("at"), F.lit(item).alias("item"), x["e"].alias("e"), i.alias("i"))
    both = F.sort_array(F.concat(F.transform(base, lambda x: event(x, 0, F.lit(-1))), F.transform(items, lambda x, i: event(x, 1, i))))

    def flags(ev: Column) -> Column:
        reach = running(F.transform(ev, lambda x: F.when(x["item"] == 0, x["e"]).otherwise(F.lit(-1))), lambda a, b: F.greatest(a, b), -1)
        ahead = running(F.transform(F.reverse(ev), lambda x: F.when(x["item"] == 0, x["at"]).otherwise(F.lit(FAR))), lambda a, b: F.least(a, b), FAR)

        def with_both(w: Column) -> Column:
            n = F.size(ev)
            hit = lambda x, k: F.struct(x["i"].alias("i"), ((F.get(w["reach"], k) > x["at"]) | (F.get(w["ahead"], n - 1 - k) < x["e"])).alias("hit"))
            return F.transform(F.filter(F.sort_array(F.transform(ev, hit)), lambda x: x["i"] >= 0), lambda x: x["hit"])

        return let(F.struct(reach.alias("reach"), ahead.alias("ahead")), with_both)

    nothing = F.transform(items, lambda x: F.lit(False))
    return F.when((F.size(base) == 0) | (F.size(items) == 0), nothing).otherwise(let(both, flags))


def merged(spans: Column) -> Column:
    """``array<struct<s, e>>``: the spans' union, apart from each other and in order; spans that touch stay apart."""

    def made(x: Column) -> Column:
        reach = running(F.transform(x, lambda m: m["e"]), lambda a, b: F.greatest(a, b), -1)

        def joined(r: Column) -> Column:
            first = F.filter(F.sequence(F.lit(0), F.size(x) - 1), lambda i: (i == 0) | (F.get(x, i)["s"] >= F.get(r, i - 1)))
            last = lambda f, k: F.coalesce(F.get(f, k + 1), F.size(x)) - 1
            return let(first, lambda f: F.transform(f, lambda i, k: F.struct(F.get(x, i)["s"].alias("s"), F.get(r, last(f, k)).alias("e"))))

        return let(reach, joined)

    ordered = F.sort_array(F.transform(spans, lambda m: F.struct(m["s"].alias("s"), m["e"].alias("e"))))
    return F.when(F.size(spans) > 0, let(ordered, made)).otherwise(F.expr("cast(array() as array<struct<s:int,e:int>>)"))


def replaced(text: Column, apart: Column, mark: str) -> Column:
    """The text with each of the spans ``apart`` (:func:`merged`) replaced by ``mark``, cut in blocks of spans."""

    def made(m: Column) -> Column:
        n = F.size(m)
        ended = lambda i: F.when(i > 0, F.get(m, i - 1)["e"]).otherwise(F.lit(0))

        def in_blocks(w: Column) -> Column:
            def block(b: Column) -> Column:
                last = F.least(n, (b + 1) * w) - 1
                start = ended(b * w)
                end = F.when(last == n - 1, F.length(text)).otherwise(F.get(m, last)["e"])
                part = F.struct(F.substring(text, start + 1, end - start).alias("text"), start.alias("start"), last.alias("last"))

                def written_out(p: Column) -> Column:
                    one = lambda i: F.concat(F.substring(p["text"], ended(i) - p["start"] + 1, F.get(m, i)["s"] - ended(i)), F.lit(mark))
                    rest = F.when(p["last"] == n - 1, F.substring(p["text"], F.get(m, p["last"])["e"] - p["start"] + 1, F.length(p["text"]))).otherwise(F.lit(""))
                    return F.concat(F.array_join(F.transform(F.sequence(b * w, p["last"]), one), ""), rest)

                return let(part, written_out)

            return F.array_join(F.transform(F.sequence(F.lit(0), ((n - 1) / w).cast("int")), block), "")

        return let(F.ceil(F.sqrt(n)).cast("int"), in_blocks)

    return F.when(F.size(apart) > 0, let(apart, made)).otherwise(text)


def written(spans: Column, names: list[str]) -> Column:
    """``kind:start:end`` of each span, joined by commas."""
    kinds = F.array(*[F.lit(n) for n in names])
    return F.array_join(F.transform(spans, lambda m: F.concat_ws(":", F.element_at(kinds, m["k"] + 1), m["s"], m["e"])), ",")
