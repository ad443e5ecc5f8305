"""Positions of regular-expression matches, in code points, with DataFrame functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_HITS = "array<struct<start:bigint,end:bigint,match:string,value:string,before:string,after:string>>"


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use` of a value that is computed once, whatever number of times it is used."""
    return F.transform(F.array(value), use)[0]


def running_sums(numbers: Column) -> Column:
    """Inclusive prefix sums of an array of longs.

    A fold that appends copies its result at every step, so the array is folded in blocks of the root of its length and the blocks'
    own sums in one more fold: n numbers cost n * sqrt(n) copied longs.
    """
    last = lambda a: F.coalesce(F.try_element_at(a, F.lit(-1)), F.lit(0).cast("long"))
    none = F.array().cast("array<bigint>")
    append = lambda acc, x: F.concat(acc, F.array(last(acc) + x))

    def blocks(all_: Column) -> Column:
        size = F.greatest(F.lit(16), F.ceil(F.sqrt(F.size(all_)))).cast("int")
        starts = F.sequence(F.lit(0), F.floor((F.size(all_) - 1) / size).cast("int"))
        return F.transform(starts, lambda b: F.aggregate(F.slice(all_, b * size + 1, size), none, append))

    def whole(parts: Column) -> Column:
        heads = F.aggregate(parts, F.array(F.lit(0).cast("long")), lambda acc, b: append(acc, last(b)))
        return bound(heads, lambda h: F.flatten(F.transform(parts, lambda b, i: F.transform(b, lambda x: x + F.get(h, i)))))

    return bound(numbers, lambda n: F.when(F.size(n) > 0, bound(blocks(n), whole)).otherwise(none))


def find_all(text: Column, regex: str, group: int = 0, context: int = 0) -> Column:
    """Array of (start, end, match, value, before, after) of all leftmost non-overlapping matches of a Java regex.

    value is the given group; before and after are up to `context` characters on each side, within the stretch that no match of the
    same regex covers. Positions add up the lengths of the pieces between matches, so `regex` must not match the empty string.
    """

    def located(hits: Column, values: Column | None, pieces: Column) -> Column:
        steps = F.transform(hits, lambda _, i: (F.length(F.get(pieces, i)) + F.coalesce(F.length(F.get(hits, i - 1)), F.lit(0))).cast("long"))

        def one(starts: Column) -> Column:
            def row(x: Column, i: Column) -> Column:
                start = F.get(starts, i)
                side = (F.substring(F.get(pieces, i), -context, context), F.substring(F.get(pieces, i + 1), 1, context)) if context else (F.lit(""), F.lit(""))
                value = x if values is None else F.get(values, i)
                return F.struct(start.alias("start"), (start + F.length(x)).alias("end"), x.alias("match"), value.alias("value"), side[0].alias("before"), side[1].alias("after"))

            return F.transform(hits, row)

        return bound(running_sums(steps), one)

    def found(hits: Column) -> Column:
        pieces = lambda values: bound(F.split(text, regex, -1), lambda p: located(hits, values, p))
        every = pieces(None) if group == 0 else bound(F.regexp_extract_all(text, F.lit(regex), F.lit(group)), pieces)
        return F.when(F.size(hits) > 0, every).otherwise(F.array().cast(_HITS))

    return bound(F.regexp_extract_all(text, F.lit(regex), F.lit(0)), found)


def joined(spans: Column) -> Column:
    """kind:start:end of an array of (start, ord, kind, end), by start and then the kinds' order, comma-joined."""
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def number_of(spans: str, kind: str) -> Column:
    """n_<kind>: how many of the spans are of the kind."""
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
