"""Source divergence audit over a minimal acyclic transducer vocabulary.

Terms that enough documents of a language hold are sorted and built into minimal acyclic
transducers whose arc outputs add up to a term's lexicographic ordinal. Texts are streamed
through them byte by byte, many words side by side, so a recount never looks up or ships a
word: it counts ordinals. Shares of sources are then compared with each other and with
their language in exact integers, and ordinals break ties.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from os.path import commonprefix

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from polysense.llm.common import batch_of, byte_texts
from polysense.sources.store import materialize

MIN_DOCUMENTS, TOP = 30, 50
#: smoothing count and scale of shares
PRIOR, UNIT = 5, 1_000_000_000
#: a block of the vocabulary ends at so many terms or bytes of terms
BLOCK_TERMS, BLOCK_BYTES = 1 << 16, 1 << 20
#: transducers of one pass over the texts; beyond it, the texts are read once more for the rest
PASS_BYTES = 64 << 20
#: text that is streamed at a time, and counted cells a task holds before it hands them on
_CHUNK, _CELLS = 4 << 20, 1 << 21
#: ordinals and sources of one comparison
SLICE, TILE = 4096, 256

_SPACED = bytes(b if chr(b).isalpha() else 0x20 for b in range(128)) + bytes(range(128, 256))


def spaced(text: bytes) -> bytes:
    """A-Z lowered, all that is no part of a term made a space."""
    return text.lower().translate(_SPACED)


_FREQUENCY = pa.schema([("lang", pa.string()), ("term", pa.binary()), ("n", pa.int64())])


def _document_frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents that hold a term, by language; handed on before the table grows large."""
    seen: dict[str, Counter] = {}

    def out():
        for lang, terms in seen.items():
            if terms:
                yield batch_of(_FREQUENCY, [lang] * len(terms), list(terms), list(terms.values()))
        seen.clear()

    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), byte_texts(batch.column(1))):
            seen.setdefault(lang, Counter()).update(set(spaced(text).split()))
            if sum(map(len, seen.values())) > 400_000:
                yield from out()
    yield from out()


# ---- the transducer


class Transducer:
    """Minimal acyclic automaton of sorted distinct terms; outputs along a term's path add up to its rank.

    Arcs are ``(state << 8 | byte)`` with a target and an output.
    """

    def __init__(self, terms: list[bytes]):
        self.register: dict[tuple, int] = {}
        self.arcs: list[tuple[tuple[int, int], ...]] = []
        self.final: list[bool] = []
        self.reach: list[int] = []  # terms that end below a state
        path: list[tuple[list, list]] = [([False], [])]
        last = b""
        for term in terms:
            self._close(path, last, len(commonprefix([last, term])))
            path += [([False], []) for _ in range(len(term) + 1 - len(path))]
            path[-1][0][0] = True
            last = term
        self._close(path, last, 0)
        self.root = self._state(path[0][0][0], path[0][1])

    def _close(self, path: list, term: bytes, depth: int) -> None:
        """The states of the last term below ``depth`` are complete: equal ones become one."""
        while len(path) - 1 > depth:
            (final,), out = path.pop()
            path[-1][1].append((term[len(path) - 1], self._state(final, out)))

    def _state(self, final: bool, out: list) -> int:
        key = (final, tuple(out))
        at = self.register.get(key)
        if at is None:
            at = self.register[key] = len(self.arcs)
            self.arcs.append(key[1])
            self.final.append(final)
            self.reach.append(final + sum(self.reach[target] for _, target in out))
        return at

    def arrays(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Keys, targets and outputs of arcs, and which states are final."""
        keys, targets, outputs = [], [], []
        for state, out in enumerate(self.arcs):
            before = int(self.final[state])
            for byte, target in out:
                keys.append(state << 8 | byte)
                targets.append(target)
                outputs.append(before)
                before += self.reach[target]
        return np.array(keys, np.int64), np.array(targets, np.int32), np.array(outputs, np.int32), np.array(self.final, bool)


class Machine:
    """The transducers of a pass in one table of arcs, stepped by many words at once."""

    _EMPTY = -1

    def __init__(self, blocks: list[dict]):
        keys, targets, outputs, finals, offset = [], [], [], [], 0
        self.starts: dict[str, list[tuple[int, int]]] = {}  # by language: (root, ordinal of the block's first term)
        for b in blocks:
            final = np.frombuffer(b["final"], bool)
            keys.append(np.frombuffer(b["keys"], np.int64) + (offset << 8))
            targets.append(np.frombuffer(b["targets"], np.int32).astype(np.int64) + offset)
            outputs.append(np.frombuffer(b["outputs"], np.int32))
            finals.append(final)
            self.starts.setdefault(b["lang"], []).append((b["root"] + offset, b["base"]))
            offset += len(final)
        self.final = np.concatenate(finals)
        self._fill(np.concatenate(keys), np.concatenate(targets), np.concatenate(outputs))

    def _fill(self, keys: np.ndarray, targets: np.ndarray, outputs: np.ndarray) -> None:
        """Open addressing, half full at most: keys that find their place taken go on to the next one."""
        self.bits = max(4, int(2 * len(keys)).bit_length())
        self.mask = (1 << self.bits) - 1
        self.key = np.full(1 << self.bits, self._EMPTY, np.int64)
        self.target = np.zeros(1 << self.bits, np.int64)
        self.output = np.zeros(1 << self.bits, np.int64)
        pending, slot = np.arange(len(keys)), self._slot(keys)
        while len(pending):
            free = self.key[slot] == self._EMPTY
            _, first = np.unique(slot, return_index=True)
            won = np.zeros(len(slot), bool)
            won[first] = True
            won &= free
            at, who = slot[won], pending[won]
            self.key[at], self.target[at], self.output[at] = keys[who], targets[who], outputs[who]
            pending, slot = pending[~won], (slot[~won] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _arcs(self, keys: np.ndarray) -> np.ndarray:
        """The place of each key's arc, -1 without one."""
        slot = self._slot(keys)
        held = self.key[slot]
        slot[held == self._EMPTY] = -1
        lost = np.flatnonzero((held != keys) & (held != self._EMPTY))
        while len(lost):
            at = (slot[lost] + 1) & self.mask
            held = self.key[at]
            slot[lost] = np.where(held == self._EMPTY, -1, at)
            lost = lost[(held != keys[lost]) & (held != self._EMPTY)]
        return slot

    def ordinals(self, data: np.ndarray, start: np.ndarray, length: np.ndarray, root: np.ndarray, base: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``(word, ordinal)`` of the words of ``data`` that are terms, each stepped from its root."""
        word = np.flatnonzero(root >= 0)
        state, ordinal, at = root[word], base[word], start[word]
        left = length[word]
        found, ranks = [], []
        while len(word):
            done = left == 0
            if done.any():
                ends = done & self.final[state]
                found.append(word[ends])
                ranks.append(ordinal[ends])
                go = ~done
                word, state, ordinal, at, left = word[go], state[go], ordinal[go], at[go], left[go]
            arc = self._arcs(state << 8 | data[at])
            go = arc >= 0
            arc = arc[go]
            word, state, ordinal, at, left = word[go], self.target[arc], ordinal[go] + self.output[arc], at[go] + 1, left[go] - 1
        return np.concatenate(found or [word]), np.concatenate(ranks or [ordinal])


BLOCKS = "lang string, first binary, n long, root long, keys binary, targets binary, outputs binary, final binary, terms array<binary>"
_BLOCKS = pa.schema([("lang", pa.string()), ("first", pa.binary()), ("n", pa.int64()), ("root", pa.int64()), ("keys", pa.binary()),
                     ("targets", pa.binary()), ("outputs", pa.binary()), ("final", pa.binary()), ("terms", pa.list_(pa.binary()))])


def _build(block_terms: int):
    """Transducers of the sorted terms of a partition, one for each language and block."""
    def block(lang: str, terms: list[bytes]) -> pa.RecordBatch:
        made = Transducer(terms)
        return batch_of(_BLOCKS, [lang], [terms[0]], [len(terms)], [made.root], *[[a.tobytes()] for a in made.arrays()], [terms])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, terms, size = None, [], 0
        for batch in batches:
            for lang, term in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if terms and (lang != now or len(terms) >= block_terms or size >= BLOCK_BYTES):
                    yield block(now, terms)
                    terms, size = [], 0
                now = lang
                terms.append(term)
                size += len(term)
        if terms:
            yield block(now, terms)
    return run


_COUNTED = pa.schema([("lang", pa.string()), ("source", pa.string()), ("ordinal", pa.int64()), ("n", pa.int64())])


def _pieces(text: bytes) -> Iterator[bytes]:
    """A text in pieces that cut no word, of about ``_CHUNK`` bytes where its words allow it."""
    at = 0
    while len(text) - at > _CHUNK:
        cut = text.rfind(b" ", at, at + _CHUNK)
        if cut < 0:
            cut = text.find(b" ", at)
        if cut < 0:
            break
        yield text[at:cut]
        at = cut + 1
    yield text[at:]


def _recount(blocks: list[dict]):
    """Occurrences of terms by group and ordinal, from whole texts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = Machine(blocks)
        layers = max(map(len, machine.starts.values()))
        names: dict[tuple[str, str], int] = {}
        held: list[tuple[np.ndarray, np.ndarray]] = []
        cells = 0

        def stream(pieces: list[bytes], groups: list[int]) -> None:
            nonlocal cells
            data = np.frombuffer(b" ".join(pieces) + b" ", np.uint8)
            edge = np.diff(data != 0x20, prepend=False)
            at = np.flatnonzero(edge)
            start, length = at[::2], at[1::2] - at[::2]
            ends = np.cumsum([len(p) + 1 for p in pieces])
            piece = np.searchsorted(ends, start, side="right")
            group = np.array(groups, np.int64)
            lang = [name[0] for name in names]
            for layer in range(layers):
                entry = [s[layer] if layer < len(s := machine.starts.get(lang[g], ())) else (-1, 0) for g in groups]
                root, base = np.array(entry, np.int64).T
                word, ordinal = machine.ordinals(data, start, length, root[piece], base[piece])
                code, n = np.unique(group[piece[word]] << 40 | ordinal, return_counts=True)
                held.append((code, n))
                cells += len(code)

        def merged() -> tuple[np.ndarray, np.ndarray]:
            code = np.concatenate([c for c, _ in held])
            code, where = np.unique(code, return_inverse=True)
            n = np.zeros(len(code), np.int64)
            np.add.at(n, where, np.concatenate([n for _, n in held]))
            return code, n

        def out() -> Iterator[pa.RecordBatch]:
            code, n = merged()
            key = list(names)
            group = code >> 40
            columns = [pa.DictionaryArray.from_arrays(pa.array(group.astype(np.int32)), pa.array([k[i] for k in key], pa.string())).cast(pa.string()) for i in (0, 1)]
            for i in range(0, len(code), 1 << 16):
                part = slice(i, i + (1 << 16))
                yield batch_of(_COUNTED, columns[0][part], columns[1][part], code[part] & ((1 << 40) - 1), n[part])

        pieces, groups, size = [], [], 0
        for batch in batches:
            for lang, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), byte_texts(batch.column(2))):
                if lang not in machine.starts:
                    continue
                group = names.setdefault((lang, source), len(names))
                for piece in _pieces(spaced(text)):
                    pieces.append(piece)
                    groups.append(group)
                    size += len(piece)
                    if size >= _CHUNK:
                        stream(pieces, groups)
                        pieces, groups, size = [], [], 0
                        if cells > _CELLS:
                            held[:] = [merged()]
                            cells = len(held[0][0])
                            if cells > _CELLS // 2:
                                yield from out()
                                held.clear()
                                cells = 0
        if pieces:
            stream(pieces, groups)
        if held:
            yield from out()
    return run


# ---- vocabulary and counts


def kept_terms(rows: DataFrame, min_documents: int = MIN_DOCUMENTS) -> DataFrame:
    """``(lang, term, n)``: terms in at least ``min_documents`` rows of their language."""
    parts = rows.select("lang", "text").mapInArrow(_document_frequencies, "lang string, term binary, n long")
    return parts.groupBy("lang", "term").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_documents)


def transducers(terms: DataFrame, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """The vocabulary in sorted blocks, each with its transducer; written once."""
    ordered = terms.select("lang", "term").repartitionByRange("lang", "term").sortWithinPartitions("lang", "term")
    return materialize(ordered.mapInArrow(_build(block_terms), BLOCKS), "transducers")


def recounted(rows: DataFrame, blocks: DataFrame, pass_bytes: int = PASS_BYTES) -> tuple[DataFrame, DataFrame]:
    """Counts ``(lang, source, ordinal, n)`` above zero, and ``(lang, first, base)``, the ordinal each block starts at.

    Only a line per block and the transducers of one pass come to the driver, the latter
    at most ``pass_bytes`` (or one block). A larger vocabulary takes more passes over the texts.
    """
    spark = rows.sparkSession
    weight = F.length("keys") + F.length("targets") + F.length("outputs") + F.length("final")
    lines = sorted(blocks.select("lang", "first", "n", weight.alias("bytes")).collect(), key=lambda r: (r["lang"], bytes(r["first"])))
    seen: Counter = Counter()
    bases, passes, room = [], [], 0
    for line in lines:
        bases.append((line["lang"], bytearray(line["first"]), seen[line["lang"]]))
        seen[line["lang"]] += line["n"]
        if not passes or line["bytes"] > room:
            passes.append([])
            room = pass_bytes
        passes[-1].append(bases[-1])
        room -= line["bytes"]
    shape = "lang string, first binary, base long"
    parts = []
    for some in passes:
        these = blocks.join(F.broadcast(spark.createDataFrame(some, shape)), ["lang", "first"]).select(
            "lang", "base", "root", "keys", "targets", "outputs", "final").collect()
        machine = [r.asDict() | {c: bytes(r[c]) for c in ("keys", "targets", "outputs", "final")} for r in these]
        parts.append(rows.select("lang", "source", "text").mapInArrow(_recount(machine), "lang string, source string, ordinal long, n long"))
    counts = spark.createDataFrame([], "lang string, source string, ordinal long, n long") if not parts else parts[0]
    for part in parts[1:]:
        counts = counts.union(part)
    counts = counts.groupBy("lang", "source", "ordinal").agg(F.sum("n").alias("n"))
    return materialize(counts, "termcounts"), spark.createDataFrame(bases, shape)


def share(n: str, total: str, v: str) -> F.Column:
    """``1 + floor(UNIT * (n + PRIOR) / (total + PRIOR * v))`` in exact decimals; null without terms."""
    top = f"cast({n} + {PRIOR} AS decimal(20,0)) * cast({UNIT} AS decimal(10,0))"
    return F.expr(f"CASE WHEN {v} > 0 THEN 1 + ({top}) div cast({total} + {PRIOR} * {v} AS decimal(20,0)) END")


_PARTIAL = pa.schema([("lang", pa.string()), ("a", pa.int64()), ("b", pa.int64()), ("value", pa.int64())])


def _compare(key, table):
    """Sums of absolute differences between the sources of a tile pair, over one slice of ordinals.

    Rows with place -1 name a source, its share of an absent term and the slice's width.
    """
    lang, _, low, high = (x.as_py() for x in key)
    number, place, p, width, tile = (table.column(c).to_numpy() for c in ("number", "place", "p", "width", "tile"))
    heads = np.flatnonzero(place < 0)
    heads = heads[np.argsort(number[heads])]
    names = number[heads]
    shares = np.repeat(p[heads, None], int(width[heads[0]]), axis=1)
    body = np.flatnonzero(place >= 0)
    shares[np.searchsorted(names, number[body]), place[body]] = p[body]
    left, right = np.flatnonzero(tile[heads] == low), np.flatnonzero(tile[heads] == high)
    a, b, value = [], [], []
    for i in left.tolist():
        j = right[right > i] if low == high else right
        a += [names[i]] * len(j)
        b += names[j].tolist()
        value += np.abs(shares[j] - shares[i]).sum(axis=1).tolist()
    return pa.table([pa.array([lang] * len(a), pa.string()), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(value, pa.int64())], schema=_PARTIAL)


def _pairs(counts: DataFrame, groups: DataFrame) -> DataFrame:
    """``(lang, source, item, value)`` of ordered pairs of sources of a language.

    Shares go to cells of a slice of ordinals and a pair of source tiles, whose size is
    bounded whatever the vocabulary and the number of sources.
    """
    slices = F.greatest(F.ceil(F.col("v") / SLICE).cast("int"), F.lit(1))
    heads = groups.withColumn("slice", F.explode(F.sequence(F.lit(0), slices - 1))).select(
        "lang", "number", "tiles", "slice", F.lit(-1).alias("place"), F.coalesce("absent", F.lit(0)).cast("long").alias("p"),
        F.least(F.lit(SLICE).cast("long"), F.col("v") - F.col("slice") * SLICE).cast("int").alias("width"))
    body = counts.select("lang", "number", "tiles", F.expr(f"cast(ordinal div {SLICE} AS int)").alias("slice"),
                         (F.col("ordinal") % SLICE).cast("int").alias("place"), "p", F.lit(0).alias("width"))
    rows = heads.unionByName(body).withColumn("tile", F.expr(f"cast(number div {TILE} AS int)"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    rows = rows.withColumn("low", F.least("tile", "other")).withColumn("high", F.greatest("tile", "other")).drop("other", "tiles")
    parts = rows.groupBy("lang", "slice", "low", "high").applyInArrow(_compare, "lang string, a long, b long, value long")
    sums = parts.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    both = sums.select("lang", F.explode(F.array(F.struct(F.col("a").alias("x"), F.col("b").alias("y")), F.struct(F.col("b").alias("x"), F.col("a").alias("y")))).alias("s"), "value")
    both = both.select("lang", "s.x", "s.y", "value")
    name = lambda c, to: groups.select("lang", F.col("number").alias(c), F.col("source").alias(to))
    return both.join(name("x", "source"), ["lang", "x"]).join(name("y", "item"), ["lang", "y"]).select("lang", "source", "item", "value")


def audit(docs: DataFrame, min_documents: int = MIN_DOCUMENTS, top: int = TOP, text_col: str = "text", lang_col: str = "lang",
          source_col: str = "source", block_terms: int = BLOCK_TERMS, pass_bytes: int = PASS_BYTES) -> DataFrame:
    """``(lang, source, part, item, value, rank)``: how far sources of a language differ in their use of its terms.

    ``pair`` rows hold the sum of absolute differences between the shares of two sources
    over all kept terms, ``term`` rows the ``top`` terms a source has more of than its
    language. Null texts, languages and sources are read as empty; a source without
    terms has the smoothed shares alone; a language without kept terms has pairs of value 0
    and no terms. A repeated row is a document of its own. Ties go to the UTF-8 order of items;
    other columns are not looked at. An empty table gives an empty result.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = docs.select(text(lang_col).alias("lang"), text(source_col).alias("source"), text(text_col).alias("text"))
    blocks = transducers(kept_terms(rows, min_documents), block_terms)
    counts, bases = recounted(rows, blocks, pass_bytes)
    sizes = blocks.groupBy("lang").agg(F.sum("n").alias("v"))
    by_lang = Window.partitionBy("lang")
    groups = rows.select("lang", "source").distinct().join(
        counts.groupBy("lang", "source").agg(F.sum("n").alias("total")), ["lang", "source"], "left").join(sizes, "lang", "left")
    groups = groups.select("lang", "source", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("v", F.lit(0)).alias("v"))
    groups = groups.withColumn("lang_total", F.sum("total").over(by_lang)).withColumn(
        "number", F.row_number().over(by_lang.orderBy("source")).cast("long") - 1).withColumn(
        "tiles", F.ceil(F.count("*").over(by_lang) / TILE).cast("int"))
    groups = materialize(groups.withColumn("absent", share("0", "total", "v")), "groups")
    shares = counts.join(groups, ["lang", "source"]).withColumn("p", share("n", "total", "v"))
    pairs = _pairs(shares, groups)
    ranked = lambda df, *order: df.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), *order)))
    over = shares.withColumn("everywhere", F.sum("n").over(Window.partitionBy("lang", "ordinal"))).withColumn("q", share("everywhere", "lang_total", "v"))
    most = ranked(over.filter("p > q").select("lang", "source", "ordinal", (F.col("p") - F.col("q")).alias("value")), "ordinal").filter(F.col("rank") <= top)
    terms = blocks.join(F.broadcast(bases), ["lang", "first"]).select("lang", "base", F.posexplode("terms").alias("at", "term")).select(
        "lang", (F.col("base") + F.col("at")).alias("ordinal"), F.col("term").cast("string").alias("item"))
    named = most.join(terms, ["lang", "ordinal"])
    columns = lambda df, part: df.select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank")
    return columns(ranked(pairs, "item"), "pair").unionByName(columns(named, "term"))
