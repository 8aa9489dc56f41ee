"""Mixing sources to target weights by iterative proportional fitting.

Token totals of cells (source, language, topic) are raked until their marginals match the
targets, never above what a cell holds. A cell's raked share of its tokens is the
probability of its documents; a document is drawn by a digest of its id and its text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from polysense.llm.common import SPACE
from polysense.sources.store import materialize

DIMENSIONS = ("source", "lang", "topic")
#: share of all tokens the mixture keeps
KEEP = 0.5
#: targets are shares of tokens to this power, scaled to one: below 1 they lift small groups
TEMPER = 0.5
ROUNDS = 16
#: rounds between writes of the cell table
_STRETCH = 4
#: so many cells are raked by one task, where no group has to be brought together by a shuffle; more are dealt by group
LOCAL_CELLS = 1 << 16
NONE = "(none)"
_COLUMNS = {"id_col": "doc_id", "text_col": "text", "source_col": "source", "lang_col": "lang", "topic_col": None}
SYMBOLS = "#*$%&|<>{}=;"


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang",
             topic_col: str | None = None, carried: tuple[str, ...] = ()) -> DataFrame:
    """``(doc_id, source, lang, topic, n_tokens, drawn)``: words of whole texts, a number in [0, 1) that
    draws the row and, without a topic column, a topic by the form of the text.

    Null keys form a group of their own; a null text has no tokens. Rows are drawn by id and
    text: other texts of an id, or other rows without one, are drawn on their own, while
    rows that are equal in both are drawn alike.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    size = F.length(text)
    lines = size - F.length(F.replace(text, F.lit("\n"), F.lit("")))
    symbols = size - F.length(F.translate(text, SYMBOLS, ""))
    tokens = F.regexp_count(text, F.lit(f"[^{SPACE}]+")).cast("bigint")
    key = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(NONE))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), key(source_col).alias("source"), key(lang_col).alias("lang"),
                       tokens.alias("n_tokens"), size.alias("_size"), lines.alias("_lines"), symbols.alias("_symbols"), draw(F.col(id_col), text).alias("drawn"),
                       *[F.col(c) for c in carried],
                       *([key(topic_col).alias("topic")] if topic_col else []))
    form = (F.when(F.col("n_tokens") < 50, "short").when(F.col("_symbols") * 50 > F.col("_size"), "markup")
            .when(F.col("_lines") * 25 > F.col("n_tokens"), "lines").otherwise("prose"))
    return rows.select("doc_id", "source", "lang", (F.col("topic") if topic_col else form.alias("topic")), "n_tokens", "drawn", *carried)


def _targets(cells: DataFrame, targets: dict[str, dict[str, float]] | None, keep: float, temper: float) -> DataFrame:
    """Adds ``target_<dimension>``: tokens the group of each cell should get."""
    out = cells
    total = cells.agg(F.sum("tokens")).scalar()
    for d in DIMENSIONS:
        groups = cells.groupBy(d).agg(F.sum("tokens").alias("_group"))
        if targets and d in targets:
            given = F.element_at(F.create_map(*[F.lit(x) for k, v in targets[d].items() for x in (k, float(v))]), F.col(d))
            groups = groups.withColumn("_lifted", F.coalesce(given, F.lit(0.0)))
        else:
            groups = groups.withColumn("_lifted", F.pow(F.col("_group").cast("double"), F.lit(temper)))
        lifted = groups.agg(F.sum("_lifted")).scalar()
        out = out.join(groups.select(d, (F.col("_lifted") / lifted * total * keep).alias(f"target_{d}")), d)
    return out


def raked_cells(rows: DataFrame, targets: dict[str, dict[str, float]] | None = None, keep: float = KEEP, temper: float = TEMPER,
                rounds: int = ROUNDS, local_cells: int | None = None) -> DataFrame:
    """``(source, lang, topic, tokens, docs, weight, probability)``, one row per cell of measured ``rows``.

    ``targets`` gives shares by group name for some dimensions; groups it leaves out get
    nothing. The others are tempered shares of what is there. Only the cell table is raked;
    its size follows the number of groups, not of documents. The last round rakes sources last.
    Up to ``local_cells`` cells are raked by one task: the driver then plans the rounds without
    a shuffle for each of their windows. More cells are shuffled by group.
    """
    cells = materialize(rows.groupBy(*DIMENSIONS).agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("docs")), "cells")
    few = cells.count() <= (LOCAL_CELLS if local_cells is None else local_cells)
    together = lambda df: df.coalesce(1) if few else df
    current = materialize(_targets(together(cells), targets, keep, temper).withColumn("weight", F.col("tokens").cast("double")), "cells")
    for done in range(rounds):
        if done % _STRETCH == 0:
            current = together(current)
        for d in reversed(DIMENSIONS):
            now = F.sum("weight").over(Window.partitionBy(d))
            raked = F.when(now > 0, F.col("weight") * F.col(f"target_{d}") / now).otherwise(F.lit(0.0))
            current = current.withColumn("weight", F.least(raked, F.col("tokens").cast("double")))
        if (done + 1) % _STRETCH == 0 or done + 1 == rounds:
            current = materialize(current, "cells")
    chance = F.when(F.col("tokens") > 0, F.col("weight") / F.col("tokens")).otherwise(F.lit(keep))
    return current.select(*DIMENSIONS, "tokens", "docs", "weight", chance.alias("probability"))


def residuals(cells: DataFrame, targets: dict[str, dict[str, float]] | None = None, keep: float = KEEP, temper: float = TEMPER) -> DataFrame:
    """``(dimension, name, tokens, target, weight)``: what raking aimed at and reached, for each group of each dimension.

    A group stays below its target where its cells hold too few tokens.
    """
    aimed = materialize(_targets(cells.select(*DIMENSIONS, "tokens", "weight"), targets, keep, temper), "aimed")
    parts = [aimed.groupBy(F.col(d).alias("name")).agg(F.sum("tokens").alias("tokens"), F.first(f"target_{d}").alias("target"), F.sum("weight").alias("weight")).select(
        F.lit(d).alias("dimension"), "name", "tokens", "target", "weight") for d in DIMENSIONS]
    return parts[0].union(parts[1]).union(parts[2])


def draw(doc_id: Column, text: Column) -> Column:
    """A number in [0, 1) by the digest of an id and a text."""
    name = F.concat(F.coalesce(doc_id.cast("string"), F.lit(NONE)), F.lit(":"), F.md5(text.cast("binary")))
    return F.conv(F.substring(F.md5(name.cast("binary")), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def mixture(docs: DataFrame, targets: dict[str, dict[str, float]] | None = None, keep: float = KEEP, temper: float = TEMPER,
            rounds: int = ROUNDS, **columns: str) -> DataFrame:
    """``(doc_id, source, lang, topic, n_tokens, weight, probability, kept)`` per row of ``docs``.

    ``weight`` is the cell's raked tokens. Rows equal in id and text are drawn alike, others
    on their own, whether ids repeat or lack. Documents without tokens are kept with
    probability ``keep`` where their whole cell has none. An empty table gives an empty
    result. The hottest source stays spread: sums combine before they shuffle, and
    documents meet only the cell table.
    """
    rows = materialize(measured(docs, **columns), "measured")
    cells = raked_cells(rows, targets, keep, temper, rounds).select(*DIMENSIONS, "weight", "probability")
    return rows.join(cells, list(DIMENSIONS)).withColumn("kept", F.col("drawn") < F.col("probability")).select(
        "doc_id", *DIMENSIONS, "n_tokens", "weight", "probability", "kept")


def sampled(docs: DataFrame, targets: dict[str, dict[str, float]] | None = None, keep: float = KEEP, temper: float = TEMPER,
            rounds: int = ROUNDS, **columns: str) -> DataFrame:
    """The rows of ``docs`` that the mixture keeps, with their own columns, drawn where they stand.

    Each row is measured again and meets the cell table, which is broadcast while it is
    small; no text is shuffled then.
    """
    cells = raked_cells(measured(docs, **columns), targets, keep, temper, rounds).select(*DIMENSIONS, "probability")
    read = {columns.get(k, v) for k, v in _COLUMNS.items()} - {None}
    rows = measured(docs.select(*[F.col(f"`{c}`") for c in sorted(read)], F.struct("*").alias("_row")), carried=("_row",), **columns)
    return rows.join(cells, list(DIMENSIONS)).filter(F.col("drawn") < F.col("probability")).select("_row.*")
