"""Fuzzy search for short licence notices.

A text is normalised once (words of ASCII letters and digits and of non-ASCII bytes, lower-cased, one space between).
A notice of m bytes that may have e edits is cut into e + 1 pieces: by the pigeonhole principle one piece of any
match within e edits stands there unchanged, so exact search for the pieces finds every candidate. Around each
candidate the regex library's bounded-error matching decides, and tells the edits and the span.

Base phrases are exact word sequences. Null and empty texts have no words and no labels; repeated rows are scanned one
by one; texts of any length are scanned whole, a slice at a time. One scan, no shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from . import kernel as K

#: Exact phrases and their labels (fixed values of the contract).
BASE = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)
#: Short notices that are searched with errors (this operator's own list).
NOTICES = (
    ("gnu general public license", "gpl"),
    ("gnu lesser general public license", "lgpl"),
    ("gnu affero general public license", "agpl"),
    ("licensed under the apache license", "apache"),
    ("released under the mit license", "mit"),
    ("permission is hereby granted free of charge", "mit"),
    ("licensed under cc by nc", "cc-by-nc"),
    ("licensed under cc by sa", "cc-by-sa"),
    ("creative commons attribution", "cc-by"),
    ("redistribution and use in source and binary forms", "bsd"),
    ("mozilla public license", "mpl"),
    ("eclipse public license", "epl"),
    ("all rights reserved", "proprietary"),
)


def edits_for(phrase: str) -> int:
    """One edit for each ten characters, at most three."""
    return min(3, max(1, len(phrase) // 10))


class Notice:
    def __init__(self, phrase: str, label: str):
        self.text, self.label, self.edits = phrase.encode(), label, edits_for(phrase)
        cuts = [round(i * len(self.text) / (self.edits + 1)) for i in range(self.edits + 2)]
        self.seeds = [(a, self.text[a:b]) for a, b in zip(cuts, cuts[1:])]
        self.rx = regex.compile(rb"(?b)(?:" + regex.escape(self.text) + rb"){e<=" + str(self.edits).encode() + rb"}")


def normal(raw: np.ndarray, off: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """Normalised bytes with a newline after each row, each row's start (and the end), word starts, first word of each row."""
    inside = K.WORDISH[raw]
    edge = inside.copy()
    edge[1:] |= inside[:-1]
    if len(raw):
        heads = off[:-1][off[:-1] < len(raw)]
        edge[heads] = inside[heads]
    place = np.concatenate([[0], np.cumsum(edge)])[off]
    body = np.where(inside, K.LOWER[raw], np.uint8(32))[edge]
    full = np.insert(body, place[1:], 10)
    begin = place + np.arange(len(place))
    ok = K.WORDISH[full]
    starts = np.flatnonzero(ok & ~np.concatenate([[False], ok[:-1]]))
    return full.tobytes(), begin, starts, np.searchsorted(starts, begin)


def _places(hay: bytes, needle: bytes) -> Iterator[int]:
    at = hay.find(needle)
    while at >= 0:
        yield at
        at = hay.find(needle, at + 1)


def scan_slice(raw: np.ndarray, off: np.ndarray, notices: list[Notice]) -> tuple[np.ndarray, dict[int, list], dict[int, list]]:
    """Words of each row; by row, base places (word, label) and fuzzy hits (first word, last word, label, edits, size)."""
    hay, begin, starts, first = normal(raw, off)
    base: dict[int, list] = {}
    for phrase, label in BASE:
        p = phrase.encode()
        for at in _places(hay, p):
            end = at + len(p)
            if (at == 0 or hay[at - 1] in b" \n") and hay[end] in b" \n":
                row = int(np.searchsorted(begin, at, "right")) - 1
                base.setdefault(row, []).append((int(np.searchsorted(starts, at)) - int(first[row]), label))
    fuzzy: dict[int, list] = {}
    for notice in notices:
        done: set[tuple[int, int]] = set()
        looked: set[int] = set()
        for shift, seed in notice.seeds:
            for at in _places(hay, seed):
                row = int(np.searchsorted(begin, at, "right")) - 1
                if at - shift in looked:
                    continue
                looked.add(at - shift)
                left = max(int(begin[row]), at - shift - notice.edits)
                right = min(int(begin[row + 1]) - 1, at - shift + len(notice.text) + notice.edits)
                m = notice.rx.search(hay, left, right)
                if m and (span := m.span()) not in done:
                    done.add(span)
                    f = int(first[row])
                    lo = int(np.searchsorted(starts, span[0], "right")) - 1 - f
                    hi = int(np.searchsorted(starts, span[1])) - 1 - f
                    fuzzy.setdefault(row, []).append((max(lo, 0), max(lo, hi, 0), notice.label, sum(m.fuzzy_counts), len(notice.text)))
    return np.diff(first), base, {row: nearest(hits) for row, hits in fuzzy.items()}


def nearest(hits: list) -> list:
    """Without those that overlap a hit of another label with fewer edits."""
    kept: list = []
    at: dict[int, list] = {}  # kept hits by each word that they cover; a hit covers a few
    for h in sorted(hits, key=lambda x: (x[3], x[0], x[2])):
        words = range(h[0], h[1] + 1)
        if not any(k[3] < h[3] and k[2] != h[2] for w in words for k in at.get(w, ())):
            kept.append(h)
            for w in words:
                at.setdefault(w, []).append(h)
    return kept


SPAN = pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("edits", pa.int32())]))
SCHEMA = (
    "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, "
    "spans array<struct<label:string,first_word:bigint,last_word:bigint,edits:int>>"
)


def scan(docs: DataFrame, keep_columns: list[str], text: str = "text") -> DataFrame:
    """keep_columns of every row with its base places, labels, the best likeness to a notice (1: exact) and fuzzy spans.

    Neighbouring seeds of one place may see it as spans that differ by an edit at an end; all of them are told.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        notices = [Notice(*x) for x in NOTICES]
        for b in batches:
            cols: list[list] = [[] for _ in range(8)]
            for _, raw, off in K.slices(b.column(b.num_columns - 1)):
                n, base, fuzzy = scan_slice(raw, off, notices)
                for row, words in enumerate(n.tolist()):
                    exact, near = base.get(row, ()), fuzzy.get(row, ())
                    names = {x[1] for x in exact}
                    score = 1.0 if exact else max((1 - x[3] / x[4] for x in near), default=0.0)
                    told = (
                        words, len(exact), min((x[0] for x in exact), default=None), max((x[0] for x in exact), default=None), ",".join(sorted(names)),
                        ",".join(sorted(names | {x[2] for x in near})), score, [{"label": x[2], "first_word": x[0], "last_word": x[1], "edits": x[3]} for x in sorted(near)],
                    )
                    for c, v in zip(cols, told):
                        c.append(v)
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), SPAN]
            arrays = [pa.array(c, k) for c, k in zip(cols, kinds)]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *arrays], [*b.schema.names[:-1], *NAMES])

    return K.framed(docs, keep_columns, text, run, SCHEMA)


NAMES = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"]
