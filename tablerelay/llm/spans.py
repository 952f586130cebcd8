"""Where a pattern matches in a text, with built-in functions alone."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Matches are summed up in groups of so many, so that very many in a text stay cheap.
GROUP = 128

SPANS = "array<struct<start:int,end:int,hit:string>>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def find_spans(text: Column, pattern: str, only_where: Column | None = None) -> Column:
    """The leftmost non-overlapping matches, as ``start`` and ``end`` in code points and
    ``hit``. The pattern has no groups that capture and matches no empty text.

    ``only_where`` is something cheap that every text with a match fulfils: the others are
    not searched.
    """
    gaps = F.split(text, pattern, -1)
    hits = F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1))
    parts = F.struct(F.transform(gaps, F.length).alias("gap"), hits.alias("hit"))
    worth = text.rlike(pattern) if only_where is None else only_where & text.rlike(pattern)
    return F.when(worth, let(parts, _placed)).otherwise(F.array().cast(SPANS))


def _placed(of: Column) -> Column:
    """A match starts after all gaps and matches before it and its own gap."""
    n = F.size(of["hit"])
    steps = F.zip_with(F.slice(of["gap"], F.lit(1), n), of["hit"], lambda gap, hit: gap + F.length(hit))

    groups = F.sequence(F.lit(0), F.floor((n - 1) / GROUP).cast("int"))

    def span(step: Column, base: Column, i: Column, hit: Column) -> Column:
        group = F.floor(i / GROUP).cast("int")
        before = F.element_at(base, group + 1) + _sum(F.slice(step, group * GROUP + 1, i - group * GROUP))
        start = before + F.element_at(of["gap"], i + 1)
        return F.struct(start.alias("start"), (start + F.length(hit)).alias("end"), hit.alias("hit"))

    def placed(step: Column) -> Column:
        sums = F.transform(groups, lambda g: _sum(F.slice(step, g * GROUP + 1, F.lit(GROUP))))
        bases = let(sums, lambda s: F.transform(groups, lambda g: _sum(F.slice(s, F.lit(1), g))))
        return let(bases, lambda base: F.transform(of["hit"], lambda hit, i: span(step, base, i, hit)))

    return let(steps, placed)


def _sum(numbers: Column) -> Column:
    return F.aggregate(numbers, F.lit(0), lambda a, b: a + b)
