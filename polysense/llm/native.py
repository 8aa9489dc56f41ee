"""Column helpers for operators made of built-in functions alone.

Long SQL is put into ``if(...)``, not into CASE or CAST: to tell those from functions of the same
name the parser looks ahead over all of it, and keeps what it saw in the driver's heap for good.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import count

from pyspark.sql import Column, functions as F

from polysense.llm.common import SPACE

_RUN = 256


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once, however often ``use`` names it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def words(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text, in order."""
    return F.filter(F.split(text, f"[{SPACE}]+"), lambda w: w != "")


_names = count()


def sql_let(value: str, use: Callable[[str], str]) -> str:
    """SQL form of ``let``."""
    name = f"v{next(_names)}"
    return f"element_at(transform(array({value}), {name} -> {use(name)}), 1)"


def sql_running(values: str) -> str:
    """Sums of the values before each place, in runs so that long arrays are not copied again and again."""
    def prefix(array: str, start: str) -> str:
        return (f"aggregate({array}, named_struct('out', cast(array() AS array<bigint>), 'at', {start}), "
                "(s, x) -> named_struct('out', array_append(s.out, s.at), 'at', s.at + x)).out")

    def of_runs(runs: str) -> str:
        totals = f"transform({runs}, r -> aggregate(r, 0L, (s, x) -> s + x))"
        return f"flatten(zip_with({runs}, {prefix(totals, '0L')}, (a, h) -> {prefix('a', 'h')}))"

    def of_values(v: str) -> str:
        runs = f"transform(sequence(0, cast(floor((size({v}) - 1) / {_RUN}) AS int)), i -> slice({v}, i * {_RUN} + 1, {_RUN}))"
        return f"if(size({v}) = 0, cast(array() AS array<bigint>), {sql_let(runs, of_runs)})"

    return sql_let(values, of_values)


def sql_matches(text: str, pattern: str) -> str:
    """Leftmost non-overlapping matches as structs ``(start, end, hit)``, in code points.

    The gaps between matches and the matches themselves give the places. The pattern
    holds no quotation marks.
    """
    p = f"r'{pattern}'"

    def place(f: str) -> str:
        sizes = (f"zip_with(slice({f}.gaps, 1, size({f}.hits)), {f}.hits, "
                 "(g, h) -> named_struct('gap', cast(length(g) AS bigint), 'size', cast(length(h) AS bigint), 'hit', h))")

        def build(q: str) -> str:
            before = sql_running(f"transform({q}, m -> m.gap + m.size)")
            return (f"zip_with({q}, {before}, (m, at) -> named_struct('start', at + m.gap, 'end', at + m.gap + m.size, 'hit', m.hit))")

        return sql_let(sizes, build)

    found = sql_let(f"named_struct('gaps', split({text}, {p}, -1), 'hits', regexp_extract_all({text}, {p}, 0))", place)
    return f"if(regexp_like({text}, {p}), {found}, cast(array() AS array<struct<start:bigint,end:bigint,hit:string>>))"
