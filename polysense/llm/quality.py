"""Line-first cleaning: rules per line, then a verdict on what is left of a document.

Lines that look like navigation, boilerplate, markup or shouting, that are mostly symbols
or repeat an earlier line are removed; a document that keeps too few of its words is
rejected. Everything is one narrow projection: no shuffle, no Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from polysense.llm.common import SPACE, rows_of
from polysense.llm.native import let, words

MIN_WORDS = 50
#: repeated share of words, in percent, that fails a document
MAX_REPEATED = 50
#: symbols of markup and noise
SYMBOLS = "#*$%&|<>"
#: a document must keep this share of its words, in percent
MIN_KEPT = 50
#: a line without a sentence end is navigation if it is one word, or has a separator in so many words, or two in so many
NAVIGATION_WORDS, MENU_WORDS = 4, 15
SEPARATORS = "[|›»>·•→]"
BOILERPLATE = (
    "all rights reserved|privacy policy|terms of (?:use|service)|cookie(?:s)? (?:policy|settings)|accept cookies|click here"
    "|enable javascript|lorem ipsum|copyright ©|log ?in|sign up|subscribe to our newsletter|skip to content"
)
SENTENCE_END = "[.!?…。！？:;][\"'”’»)\\]]*$"


def _covered(starts: Column) -> Column:
    """Words that 3-word windows at the sorted places ``starts`` cover."""
    step = F.aggregate(
        starts, F.struct(F.lit(-3).cast("bigint").alias("last"), F.lit(0).cast("bigint").alias("sum")),
        lambda s, x: F.struct(x.alias("last"), (s["sum"] + F.least(F.lit(3).cast("bigint"), x - s["last"])).alias("sum")))
    return step["sum"]


def repeated_words(array: Column) -> Column:
    """Words in 3-word windows that occur twice or more in ``array``, first ones included.

    Windows are sorted as numbers that hold a hash above the window's place; equal
    hashes then are neighbours, and neighbours are compared by their whole hashes.
    """
    def of_words(w: Column) -> Column:
        hashes = F.transform(F.sequence(F.lit(1), F.size(w) - 2), lambda i: F.xxhash64(F.get(w, i - 1), F.get(w, i), F.get(w, i + 1)))
        return let(hashes, of_hashes)

    def of_hashes(h: Column) -> Column:
        bits = F.ceil(F.log2(F.size(h) + F.lit(1))).cast("int")
        return let(F.struct(h.alias("h"), F.call_function("shiftleft", F.lit(1).cast("bigint"), bits).alias("unit")), of_sized)

    def of_sized(p: Column) -> Column:
        packed = F.transform(p["h"], lambda x, i: (x - F.pmod(x, p["unit"])) + i)
        return let(F.struct(p["h"].alias("h"), p["unit"].alias("unit"), F.sort_array(packed).alias("sorted")), of_sorted)

    def of_sorted(p: Column) -> Column:
        place = F.transform(p["sorted"], lambda x: F.pmod(x, p["unit"]).cast("int"))

        def of_places(q: Column) -> Column:
            near = lambda a, b: F.coalesce(F.get(p["h"], F.get(q, a)) == F.get(p["h"], F.get(q, b)), F.lit(False))
            hits = F.filter(q, lambda x, i: near(i, i + 1) | ((i > 0) & near(i, i - 1)))
            return _covered(F.transform(F.sort_array(hits), lambda x: x.cast("bigint")))
        return let(place, of_places)

    return F.when(F.size(array) < 3, F.lit(0).cast("bigint")).otherwise(let(array, of_words))


def _line_fails(line: Column, n: Column) -> Column:
    """The rules of a line of ``n`` words."""
    size = F.length(line)
    symbols = size - F.length(F.translate(line, SYMBOLS, ""))
    letters = F.length(F.regexp_replace(line, "\\P{L}+", ""))
    capitals = F.length(F.regexp_replace(line, "\\P{Lu}+", ""))
    ended = F.regexp_like(line, F.lit(SENTENCE_END))
    steps = F.regexp_count(line, F.lit(SEPARATORS))
    navigation = ~ended & ((n <= 1) | ((n <= NAVIGATION_WORDS) & (steps >= 1)) | ((n <= MENU_WORDS) & (steps >= 2)))
    boilerplate = (n <= 30) & F.regexp_like(F.lower(line), F.lit(BOILERPLATE))
    noise = symbols * 10 > size
    shouting = (letters >= 20) & (capitals * 10 > letters * 8)
    unlettered = letters * 3 < size - n
    return navigation | boilerplate | noise | shouting | unlettered


def clean_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: the base measures, the cleaned text and the verdict.

    Columns ``doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    n_lines_removed, n_words_left, base_failed, kept, clean_text``. A null text has no
    words; texts without words fail. Rows are judged one by one, so repeated rows and
    null ids are kept with equal results. An empty table gives an empty result.
    """
    rows = rows_of(docs, doc_id=id_col, text=text_col).withColumn("text", F.coalesce(F.col("text").cast("string"), F.lit("")))

    def measures(w: Column) -> Column:
        text = F.col("text")
        lines = F.filter(F.split(text, "\n"), lambda x: F.regexp_like(x, F.lit(f"[^{SPACE}]")))

        def of_lines(ls: Column) -> Column:
            distinct = F.array_distinct(ls)
            passed = F.filter(F.transform(distinct, lambda x: F.struct(x.alias("line"), F.regexp_count(x, F.lit(f"[^{SPACE}]+")).alias("n"))),
                              lambda x: ~_line_fails(x["line"], x["n"]))
            return let(passed, lambda p: F.struct(
                (F.size(ls) - F.size(distinct)).cast("bigint").alias("dup"), (F.size(ls) - F.size(p)).cast("bigint").alias("removed"),
                F.aggregate(p, F.lit(0).cast("bigint"), lambda s, x: s + x["n"]).alias("left"),
                F.array_join(F.transform(p, lambda x: x["line"]), "\n").alias("text")))

        return F.struct(
            F.size(w).cast("bigint").alias("n_words"),
            (F.length(text) - F.length(F.translate(text, "\x20\x09\x0a\x0b\x0c\x0d", ""))).cast("bigint").alias("spaces"),
            (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("bigint").alias("n_symbols"),
            repeated_words(w).alias("n_repeat_words"), let(lines, of_lines).alias("lines"))

    m = rows.select("doc_id", F.length("text").cast("bigint").alias("size"), let(words(F.col("text")), measures).alias("m"))
    m = m.select("doc_id", "size", F.explode(F.array("m")).alias("m"))  # holds the measures: later columns do not compute them again
    base = (F.col("m.n_words") < MIN_WORDS) | (100 * F.col("m.n_repeat_words") > MAX_REPEATED * F.col("m.n_words"))
    return m.select(
        "doc_id", F.col("m.n_words").alias("n_words"), (F.col("size") - F.col("m.spaces")).alias("word_chars"), F.col("m.n_symbols").alias("n_symbols"),
        F.col("m.lines.dup").alias("n_dup_lines"), F.col("m.n_repeat_words").alias("n_repeat_words"),
        F.col("m.lines.removed").alias("n_lines_removed"), F.col("m.lines.left").alias("n_words_left"), base.alias("base_failed"),
        (~base & (F.col("m.lines.left") * 100 >= MIN_KEPT * F.col("m.n_words"))).alias("kept"), F.col("m.lines.text").alias("clean_text"))
