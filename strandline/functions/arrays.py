"""Functions on arrays: sets that keep repeats, chunks, padding, windows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def unique(a: Column) -> Column:
    """First occurrences, in order."""
    return F.array_distinct(a)


def _once(value: Column, then: Callable[[Column], Column]) -> Column:
    # the value in an array of one, so that it is worked out once a row and not once an element
    return F.get(F.transform(F.array(value), then), F.lit(0))


def difference(a: Column, b: Column) -> Column:
    """What of `a` isn't in `b`, repeats kept."""
    return _once(b, lambda other: F.filter(a, lambda x: ~F.array_contains(other, x)))


def intersection(a: Column, b: Column) -> Column:
    """What of `a` is in `b`, repeats kept."""
    return _once(b, lambda other: F.filter(a, lambda x: F.array_contains(other, x)))


def chunks(a: Column, size: int) -> Column:
    starts = F.when(F.size(a) > 0, F.sequence(F.lit(1), F.size(a), F.lit(size))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.slice(a, i, size))


def top_k(values: Column, k: int) -> Column:
    """(place from 0, value) of the k greatest values; ties by place."""
    placed = F.transform(values, lambda v, i: F.struct((-v).alias("key"), i.alias("place"), v.alias("value")))
    return F.transform(F.slice(F.array_sort(placed), 1, k), lambda p: F.struct(p["place"].alias("place"), p["value"].alias("value")))


def padded(a: Column, length: int, pad: Column) -> Column:
    """Cut to the first `length` elements, or padded on the right."""
    return F.concat(F.slice(a, 1, length), F.array_repeat(pad, F.greatest(F.lit(length) - F.size(a), F.lit(0))))


def head_and_last(a: Column, length: int) -> Column:
    """The first element and the last length - 1, where an array is longer than `length`."""
    return F.when(F.size(a) > length, F.concat(F.slice(a, 1, 1), F.slice(a, -(length - 1), length - 1))).otherwise(a)


def window_starts(size: Column, stride: int) -> Column:
    """0, stride, ... below size - 1; none for fewer than two elements."""
    return F.when(size >= 2, F.sequence(F.lit(0), size - 2, F.lit(stride))).otherwise(F.array().cast("array<int>"))


def sliding(a: Column, window: int, stride: int) -> Column:
    """(start, end, input, target): stretches of `window` elements and the element after each."""

    def one(i: Column) -> Column:
        end = F.least(i + window, F.size(a) - 1)
        return F.struct(i.alias("start"), end.alias("end"), F.slice(a, i + 1, end - i).alias("input"), F.get(a, end).alias("target"))

    return F.transform(window_starts(F.size(a), stride), one)


def parts(text: Column, separator: str, count: int, missing: str = "\\N") -> list[Column]:
    """The first `count` parts of a text, each filled where there are fewer."""
    cut = F.split(text, separator)
    return [F.coalesce(F.get(cut, i), F.lit(missing)) for i in range(count)]
