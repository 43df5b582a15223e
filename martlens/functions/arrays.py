"""Array helpers that keep long arrays linear.

Lambdas of ``transform``/``filter``/``aggregate`` are evaluated once per element, and so is every
expression inside them: an array built inside a lambda is built again for each element, and an array
that an ``aggregate`` grows is copied for each. ``let`` binds a value once per row; ``scanned`` and
``picked`` grow arrays within blocks of fixed size only.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

BLOCK = 128


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once per row however often body looks at it."""
    return F.get(F.transform(F.array(value), body), 0)


def blocks(values: Column) -> Column:
    """The array in pieces of BLOCK elements; bind ``values`` before."""
    return F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.size(values) - 1) / BLOCK).cast("int"))),
                       lambda b: F.slice(values, b * BLOCK + 1, F.lit(BLOCK)))


def scanned(values: Column, join: Callable[[Column, Column], Column]) -> Column:
    """Inclusive running values of a non-empty array under an associative join."""
    def within(block: Column) -> Column:
        return F.aggregate(F.slice(block, 2, BLOCK), F.slice(block, 1, 1),
                           lambda a, x: F.concat(a, F.array(join(F.element_at(a, -1), x))))

    def whole(v: Column) -> Column:
        return let(F.transform(blocks(v), within), lambda bs: let(
            # the running value at the end of each block
            F.aggregate(F.slice(bs, 2, F.size(bs)), F.array(F.element_at(F.get(bs, 0), -1)),
                        lambda a, b: F.concat(a, F.array(join(F.element_at(a, -1), F.element_at(b, -1))))),
            lambda ends: F.flatten(F.transform(bs, lambda b, i: F.when(i == 0, b).otherwise(
                F.transform(b, lambda x: join(F.get(ends, i - 1), x)))))))

    return let(values, whole)


def picked(values: Column, start: str, end: str, kind: str) -> Column:
    """Of intervals sorted by start, those that begin after the end of the last one picked. ``kind`` is the
    array's type as a DDL string; ends are ints of 0 or more."""
    none = F.array().cast(kind)

    def taken(upto: Column, block: Column) -> Column:
        return F.aggregate(block, F.struct(upto.alias("upto"), none.alias("got")), lambda a, x: F.when(
            x[start] > a["upto"], F.struct(x[end].alias("upto"), F.concat(a["got"], F.array(x)).alias("got"))).otherwise(a))

    return let(values, lambda v: F.aggregate(
        blocks(v), F.struct(F.lit(-1).alias("upto"), none.alias("got")),
        lambda a, b: let(taken(a["upto"], b), lambda t: F.struct(
            t["upto"].alias("upto"), F.concat(a["got"], t["got"]).alias("got"))), lambda a: a["got"]))


def covered(intervals: Column, start: str, end: str) -> Column:
    """array of boolean: whether a place (0, 1, ...) is inside one of the disjoint intervals (ends inclusive,
    sorted by start); places after the last one are missing."""
    return let(intervals, lambda v: F.flatten(F.transform(v, lambda x, i: F.concat(
        F.array_repeat(F.lit(False), x[start] - F.coalesce(F.get(v, i - 1)[end] + 1, F.lit(0))),
        F.array_repeat(F.lit(True), x[end] - x[start] + 1)))))
