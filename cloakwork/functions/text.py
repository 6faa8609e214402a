"""Column helpers: binding a value once, JavaScript's rounding, places of all matches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .patterns import java

SPAN = "array<struct<start:int,end:int,kind:string>>"
#: A character that texts hardly have; where one has it, it isn't used.
_MARK = "\x01"
#: How many numbers a fold that carries an array takes at a time.
_BLOCK = 16


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value evaluated once."""
    return F.transform(F.array(value), body)[0]


def with_once(rows: DataFrame, name: str, value: Column) -> DataFrame:
    """Rows with a costly column that is evaluated once for each row.

    Projections are merged and filters pushed below them, which would evaluate the column again for
    each use; nothing is merged through the one-element explode.
    """
    return rows.select("*", F.explode(F.array(value)).alias(name))


def half_up(value: Column, digits: int = 0) -> Column:
    """Rounding to digits with halves upwards."""
    scale = 10.0**digits
    return F.floor(value * scale + 0.5) / F.lit(scale)


def utf16_units(text: Column) -> Column:
    return (F.octet_length(F.encode(text, "UTF-16LE")) / 2).cast("int")


def trimmed(text: Column) -> Column:
    r"""Without white space at both ends, Unicode spaces included."""
    return F.regexp_replace(text, java(r"^\s+|\s+$"), "")


def trimmed_end(text: Column) -> Column:
    return F.regexp_replace(text, java(r"\s+$"), "")


def one_spaced(text: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return trimmed(F.regexp_replace(text, java(r"\s+"), " "))


def last_index(whole: Column, part: Column) -> Column:
    """Where the part begins for the last time in whole, from 0."""
    return F.length(whole) - F.length(part) - (F.position(F.reverse(part), F.reverse(whole)) - 1)


def running(sizes: Column) -> Column:
    """The sum of all sizes before each, for an array of integers that is at hand.

    A fold copies what it carries at each step, so it runs over blocks and then over each block.
    """

    def fold(block: Column, at: Column) -> Column:
        first = F.struct(at.alias("at"), F.expr("cast(array() as array<int>)").alias("sums"))
        step = lambda acc, n: F.struct((acc["at"] + n).alias("at"), F.concat(acc["sums"], F.array(acc["at"])).alias("sums"))
        return F.aggregate(block, first, step, lambda acc: acc["sums"])

    def joined(blocks: Column) -> Column:
        totals = F.transform(blocks, lambda b: F.aggregate(b, F.lit(0), lambda total, n: total + n))
        return F.flatten(F.zip_with(blocks, fold(totals, F.lit(0)), fold))

    last = F.floor(F.greatest(F.size(sizes) - 1, F.lit(0)) / _BLOCK).cast("int")
    return let(F.transform(F.sequence(F.lit(0), last), lambda b: F.slice(sizes, b * _BLOCK + 1, F.lit(_BLOCK))), joined)


def matches(text: Column, pattern: str, groups: int = 0, most: Column | None = None) -> Column:
    """array<struct<start, whole, g1, ...>> of all matches, starts in code points from 0.

    The text between matches gives the places: a match begins where all gaps and matches before it end.
    Matches aren't empty.  If there are more than ``most`` all are returned, but their places aren't worked out and are 0.
    """
    # split() compiles its pattern for every row, unless it is a single character.
    marked = F.split(F.regexp_replace(text, pattern, _MARK), _MARK, -1)
    found = [F.regexp_extract_all(text, F.lit(pattern), F.lit(g)).alias(f"g{g}" if g else "whole") for g in range(groups + 1)]
    gaps = F.when(text.contains(_MARK), F.split(text, pattern, -1)).otherwise(marked)

    def listed(x: Column, start: Callable[[Column], Column]) -> Column:
        return F.transform(
            x["whole"],
            lambda w, i: F.struct(start(i).cast("int").alias("start"), w.alias("whole"), *[F.get(x[f"g{g}"], i).alias(f"g{g}") for g in range(1, groups + 1)]),
        )

    def placed(x: Column, gap: Column) -> Column:
        sizes = F.zip_with(gap, x["whole"], lambda between, w: F.length(between) + F.coalesce(F.length(w), F.lit(0)))
        several = let(sizes, lambda n: let(running(n), lambda before: listed(x, lambda i: F.get(before, i) + F.length(F.get(gap, i)))))
        return F.when(F.size(x["whole"]) == 1, listed(x, lambda i: F.length(gap[0]))).otherwise(several)

    def read(x: Column) -> Column:
        all_placed = let(gaps, lambda gap: placed(x, gap))
        return all_placed if most is None else F.when(F.size(x["whole"]) > most, listed(x, lambda i: F.lit(0))).otherwise(all_placed)

    return let(F.struct(*found), read)
