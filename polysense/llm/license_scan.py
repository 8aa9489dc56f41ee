"""License scans: fuzzy search of short notices.

A notice that occurs with at most ``k`` edits keeps one of any ``k + 1`` pieces untouched
(pigeonhole). All pieces of all notices are looked up at once by an Aho-Corasick automaton;
each hit names a small window of the text in which the ``regex`` library's bounded-error
matching verifies the notice and tells its span and its edits.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from polysense.llm.common import batch_of, byte_texts, rows_of

#: phrases whose words stand consecutively, with their labels
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: short notices (label, normalized text) that are searched with errors
NOTICES = (
    ("gpl", "gnu general public license"),
    ("lgpl", "gnu lesser general public license"),
    ("agpl", "gnu affero general public license"),
    ("gfdl", "gnu free documentation license"),
    ("apache", "licensed under the apache license"),
    ("apache", "apache license version 2 0"),
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy"),
    ("bsd", "redistribution and use in source and binary forms with or without modification"),
    ("bsd", "released under the bsd license"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose"),
    ("mpl", "mozilla public license"),
    ("epl", "eclipse public license"),
    ("boost", "boost software license"),
    ("cc-by", "licensed under cc by"),
    ("cc-by", "creative commons attribution"),
    ("cc-by-nc", "licensed under cc by nc"),
    ("cc-by-nc", "creative commons attribution noncommercial"),
    ("cc-by-sa", "creative commons attribution sharealike"),
    ("cc0", "cc0 1 0 universal"),
    ("public-domain", "released into the public domain"),
    ("public-domain", "dedicated to the public domain"),
    ("all-rights-reserved", "all rights reserved"),
)
#: one edit is allowed for every so many characters of a notice, up to a bound
EDIT_EVERY, MAX_EDITS = 11, 4

# letters, digits and all beyond ASCII make words; the rest separates them
_SPACED = bytes(b if chr(b).isalnum() or b > 0x7F else 0x20 for b in range(128)) + bytes(range(128, 256))
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
#: windows are short and repeat, so what was found in them is remembered
_REMEMBERED = 20_000


def normalized(text: bytes) -> bytes:
    """Words with A-Z lowered, one space between them."""
    return b" ".join(text.lower().translate(_SPACED).split())


def places(norm: bytes, phrase: bytes) -> list[int]:
    """Indexes of the words at which ``phrase`` stands as whole words."""
    if phrase not in norm:
        return []
    framed, wanted, found = b" " + norm + b" ", b" " + phrase + b" ", []
    at, before, word = framed.find(wanted), 0, 0
    while at >= 0:
        word += framed.count(b" ", before, at)
        before = at
        found.append(word)
        at = framed.find(wanted, at + 1)
    return found


def max_edits(notice: str) -> int:
    return min(len(notice) // EDIT_EVERY, MAX_EDITS)


@dataclass(frozen=True)
class Found:
    """A notice in a normalized text: characters ``start`` to ``end``, with the edits it took."""

    notice: int
    start: int
    end: int
    edits: int


class NoticeSearch:
    """Seeds and patterns of a set of notices, built once a task."""

    def __init__(self, notices: tuple[tuple[str, str], ...]):
        import ahocorasick
        import regex

        self.notices = notices
        self.bound = [max_edits(text) for _, text in notices]
        # one pattern for each number of edits: the first that matches tells the fewest
        self.patterns = [[regex.compile(f"(?:{regex.escape(text, literal_spaces=True)}){{e<={e}}}" if e else regex.escape(text, literal_spaces=True))
                          for e in range(k + 1)] for (_, text), k in zip(notices, self.bound)]
        pieces: dict[str, list[tuple[int, int]]] = {}
        for i, ((_, text), k) in enumerate(zip(notices, self.bound)):
            cuts = [round(j * len(text) / (k + 1)) for j in range(k + 2)]
            for a, b in zip(cuts, cuts[1:]):
                pieces.setdefault(text[a:b], []).append((i, b))
        self.seeds = ahocorasick.Automaton()
        for piece, owners in pieces.items():
            self.seeds.add_word(piece, owners)
        self.seeds.make_automaton()
        self.verified = lru_cache(_REMEMBERED)(self._verified)

    def windows(self, text: str) -> Iterator[tuple[int, int, int]]:
        """``(notice, start, end)``: stretches that hold every match with a seed; of a notice they never overlap."""
        held: dict[int, tuple[int, int]] = {}
        for last, owners in self.seeds.iter(text):
            for i, end_of_piece in owners:
                first = last + 1 - end_of_piece  # where the notice would begin without edits
                k, size = self.bound[i], len(self.notices[i][1])
                low, high = max(0, first - k), min(len(text), first + size + k)
                before = held.get(i)
                if before and low <= before[1]:
                    held[i] = (min(low, before[0]), max(high, before[1]))
                else:
                    if before:
                        yield i, *before
                    held[i] = (low, high)
        for i, (low, high) in held.items():
            yield i, low, high

    def _verified(self, i: int, window: str) -> tuple[tuple[int, int, int], ...]:
        """Disjoint matches ``(start, end, edits)``: those of fewest edits first, then leftmost."""
        found, open_ = [], [(0, len(window))]
        least = len(self.notices[i][1]) - self.bound[i]
        for edits, pattern in enumerate(self.patterns[i]):
            rest = []
            for low, high in open_:
                for m in pattern.finditer(window, low, high):
                    found.append((m.start(), m.end(), edits))
                    rest.append((low, m.start()))
                    low = m.end()
                rest.append((low, high))
            open_ = [(a, b) for a, b in rest if b - a >= least]
        return tuple(sorted(found))

    def search(self, text: str) -> list[Found]:
        out = []
        for i, low, high in self.windows(text):
            for a, b, edits in self.verified(i, text[low:high]):
                out.append(Found(i, low + a, low + b, edits))
        return sorted(out, key=lambda f: (f.start, f.notice))


SPAN = "array<struct<label:string,notice:string,first_word:long,end_word:long,start:long,end:long,edits:int>>"
SCANNED = ("doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, "
           f"score double, spans {SPAN}")
_SPANS = pa.list_(pa.struct([("label", pa.string()), ("notice", pa.string()), ("first_word", pa.int64()), ("end_word", pa.int64()),
                             ("start", pa.int64()), ("end", pa.int64()), ("edits", pa.int32())]))
_SCANNED = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()),
                      ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("spans", _SPANS)])


def _spans(search: NoticeSearch, found: list[Found], norm: str, text: bytes) -> list[dict]:
    """Matches as words of the text, and as code points from the first word's start to the last one's end."""
    at = [m.span() for m in _WORD.finditer(text.decode("utf-8", "replace"))]
    out, before, word = [], 0, 0
    for f in found:
        hit = norm[f.start:f.end]
        start = f.start + len(hit) - len(hit.lstrip(" "))
        word += norm.count(" ", before, start)
        before = start
        end = word + hit.strip(" ").count(" ") + 1
        label, notice = search.notices[f.notice]
        out.append({"label": label, "notice": notice, "first_word": word, "end_word": end,
                    "start": at[word][0], "end": at[end - 1][1], "edits": f.edits})
    return out


def _scan(notices: tuple[tuple[str, str], ...], phrases: dict[str, str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = NoticeSearch(notices)
        wanted = [(phrase.encode(), label) for phrase, label in phrases.items()]
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), byte_texts(batch.column(1))):
                norm = normalized(text)
                base = {label: at for phrase, label in wanted if (at := places(norm, phrase))}
                readable = norm.decode("utf-8", "replace")
                found = search.search(readable)
                labels = sorted({*base, *(notices[f.notice][0] for f in found)})
                best = max((1.0 - f.edits / len(notices[f.notice][1]) for f in found), default=0.0)
                starts = [w for at in base.values() for w in at]
                rows.append((doc, norm.count(b" ") + 1 if norm else 0, len(starts), min(starts, default=None), max(starts, default=None),
                             ",".join(sorted(base)), ",".join(labels), 1.0 if base else best,
                             _spans(search, found, readable, text) if found else []))
            if rows:
                yield batch_of(_SCANNED, *zip(*rows))
    return run


def scan(docs: DataFrame, notices: tuple[tuple[str, str], ...] = NOTICES, phrases: dict[str, str] = PHRASES,
         id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans)``, one row per input row.

    ``n_base`` counts the places where a phrase's words stand consecutively, ``first_word``
    and ``last_word`` are the smallest and largest of their starts (null without one).
    ``spans`` are the notices found with at most an edit for every ``EDIT_EVERY``
    characters; spans of one notice never overlap. ``labels`` are those of phrases and
    notices. ``score`` is 1 where a phrase stands, else the share of characters the best
    notice kept, 0 without any. Null, empty and wordless texts have no words and no labels.
    Texts are read whole, whatever their length; repeated rows and null ids stay; other
    columns are not looked at; an empty table gives an empty result. No row leaves its task.
    """
    return rows_of(docs, doc_id=id_col, text=text_col).mapInArrow(_scan(tuple(notices), dict(phrases)), SCANNED)
