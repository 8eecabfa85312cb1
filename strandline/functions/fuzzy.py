"""Weighted fuzzy ratio of two texts, as Columns.

Ratios rest on the longest common subsequence: 100 times twice its length over both lengths. It comes from a recurrence over an array:
entry l is the least place in b up to which the characters of a read so far have l in common.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Weights of the published rule, and the quotients of lengths at which it changes.
TOKENS, PARTIAL, FAR_PARTIAL = 0.95, 0.9, 0.6
LONGER, FAR_LONGER = 1.5, 8.0


def bound(values: dict[str, Column], body: Callable[[Column], Column]) -> Column:
    """`body` over a struct of values, each worked out once a row however often it is used."""
    return F.get(F.transform(F.array(F.struct(*(v.alias(n) for n, v in values.items()))), body), F.lit(0))


def characters(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda c: c != "")


def common(a: Column, b: Column) -> Column:
    """Length of the longest common subsequence of two arrays of characters."""
    none = F.array().cast("array<int>")

    def step(least: Column, places: Column) -> Column:
        # one more in common ends at the first of the places after the one before
        nearer = F.transform(F.array_append(least, F.lit(2**31 - 1)), lambda x, l: F.least(x, F.array_min(F.filter(places, lambda p: (l == 0) | (p > F.get(least, l - 1))))))
        return F.filter(nearer, lambda x: x < 2**31 - 1)

    numbered = F.transform(b, lambda c, i: F.struct(c.alias("c"), i.alias("i")))
    places = bound({"a": a, "b": numbered}, lambda s: F.transform(s["a"], lambda c: F.transform(F.filter(s["b"], lambda n: n["c"] == c), lambda n: n["i"])))
    return F.size(F.aggregate(places, none, step))


def _of_lengths(shared: Column, lengths: Column) -> Column:
    return F.when(lengths > 0, 200.0 * shared / lengths).otherwise(100.0)


def ratio(a: Column, b: Column) -> Column:
    """100 for equal texts, 0 for texts without a common character."""
    return _of_lengths(common(characters(a), characters(b)), F.length(a) + F.length(b))


def tokens(text: Column) -> Column:
    """Words between blanks, in order of the alphabet, repeats included."""
    return F.array_sort(F.filter(F.split(text, r"\s+"), lambda w: w != ""))


def joined(parts: Column) -> Column:
    return F.array_join(parts, " ")


def token_sort_ratio(a: Column, b: Column) -> Column:
    return bound({"a": joined(tokens(a)), "b": joined(tokens(b))}, lambda s: ratio(s["a"], s["b"]))


def _sets(a: Column, b: Column, body: Callable[[Column], Column]) -> Column:
    """`body` over the different words of both (`both`), of a only (`x`) and of b only (`y`), each as one text."""
    x, y = F.array_distinct(tokens(a)), F.array_distinct(tokens(b))
    own = {"both": F.array_intersect(x, y), "x": F.array_except(x, y), "y": F.array_except(y, x)}
    return bound({k: joined(F.array_sort(v)) for k, v in own.items()}, body)


def token_set_ratio(a: Column, b: Column) -> Column:
    """The best of: common words against common words with either rest, and both of these against each other. 0 if a text has no words."""

    def body(s: Column) -> Column:
        both, x, y = (F.length(s[k]) for k in ("both", "x", "y"))
        blank = F.when(both > 0, 1).otherwise(0)
        rests = F.length(s["x"]) + F.length(s["y"]) - 2 * common(characters(s["x"]), characters(s["y"]))
        all_x, all_y = both + blank + x, both + blank + y
        between = F.when(all_x + all_y > 0, 100 - 100.0 * rests / (all_x + all_y)).otherwise(100.0)
        alone = F.greatest(100 - 100.0 * (blank + x) / (both + all_x), 100 - 100.0 * (blank + y) / (both + all_y))
        found = F.when(both == 0, between).when((x == 0) | (y == 0), 100.0).otherwise(F.greatest(between, alone))
        return found

    return F.when((F.size(tokens(a)) == 0) | (F.size(tokens(b)) == 0), 0.0).otherwise(_sets(a, b, body))


def partial_ratio(a: Column, b: Column) -> Column:
    """The ratio of the shorter text and that stretch of the longer one, no longer than it, that it is most like."""

    def best(short: Column, long: Column) -> Column:
        n, m = F.size(short), F.size(long)
        # stretches of n characters, and shorter ones at either end
        begins = F.sequence(1 - n, m - 1)

        def at(i: Column) -> Column:
            low, high = F.greatest(i, F.lit(0)), F.least(i + n, m)
            window = F.slice(long, low + 1, high - low)
            return _of_lengths(common(short, window), n + high - low)

        return F.array_max(F.transform(begins, at))

    def body(s: Column) -> Column:
        n, m = F.size(s["a"]), F.size(s["b"])
        either = F.when(n == m, F.greatest(best(s["a"], s["b"]), best(s["b"], s["a"]))).when(n < m, best(s["a"], s["b"])).otherwise(best(s["b"], s["a"]))
        return F.when((n == 0) & (m == 0), 100.0).when((n == 0) | (m == 0), 0.0).otherwise(either)

    return bound({"a": characters(a), "b": characters(b)}, body)


def partial_token_ratio(a: Column, b: Column) -> Column:
    """100 if the texts have a word in common, else the better partial ratio of all their words and of their different words, in order."""
    words = bound({"a": joined(tokens(a)), "b": joined(tokens(b))}, lambda s: partial_ratio(s["a"], s["b"]))
    rests = _sets(a, b, lambda s: F.when(s["both"] != "", 100.0).otherwise(partial_ratio(s["x"], s["y"])))
    return F.greatest(words, rests)


def weighted_ratio(a: Column, b: Column) -> Column:
    """The best of the ratios, each with its weight: of words for texts of like length, of stretches where one is 1.5 times as long or more.

    0 if either text is empty, null if either is null.
    """

    def body(s: Column) -> Column:
        a, b = s["a"], s["b"]
        n, m = F.length(a), F.length(b)
        times = F.greatest(n, m) / F.least(n, m)
        near = F.greatest(ratio(a, b), TOKENS * F.greatest(token_sort_ratio(a, b), token_set_ratio(a, b)))
        weight = F.when(times < FAR_LONGER, PARTIAL).otherwise(FAR_PARTIAL)
        far = F.greatest(ratio(a, b), weight * partial_ratio(a, b), TOKENS * weight * partial_token_ratio(a, b))
        return F.when((n == 0) | (m == 0), 0.0).when(times < LONGER, near).otherwise(far)

    return F.when(a.isNotNull() & b.isNotNull(), bound({"a": a, "b": b}, body))
