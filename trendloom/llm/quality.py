"""Quality rules as a short-circuit cascade.

Each rule rejects a document by whole-number comparisons of a few counts. A bounded sample is used for one
purpose only: to time every rule and count what it rejects there, after which rules run in falling order of
rejections per second and a rule sees only the documents that all rules before it passed. Rules are timed in the state in which
the cascade meets documents, that is, with the base counts made (which all rows put out) and without those that failed the base
rule, so a rule over base counts is charged its comparison only. A document is kept
if no rule rejects it, so the verdict doesn't depend on the order, the sample or the partitions. Ties in the order go by the
rules' places in RULES.

Nulls and empty texts have no words and fail the base rule. Repeated rows are judged one by one. Columns of the
input other than its text (and those asked for by name) aren't read.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel as K

#: Rows on which the order of the rules is estimated, and bytes that a text may have to be one of them.
SAMPLE_ROWS = 512
SAMPLE_BYTES = 1 << 16
#: Function words of the four languages, any of which marks running text (fixed values of this rule).
FUNCTION_WORDS = (
    "the be to of and that have with is in it for on are was "
    "le la les de des et un une que dans est par pour pas "
    "der die das und ist nicht mit ein eine von zu auf den "
    "el los las en y por para con una se del que no"
).split()
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True


def _sums(flags: np.ndarray, off: np.ndarray) -> np.ndarray:
    c = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=c[1:])
    return c[off[1:]] - c[off[:-1]]


def _seen(keys: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each (row, key): whether an earlier place of the row has the key, and whether any other has it."""
    h = K.mix(keys ^ (rows.astype(K.U) * K.U(0x9E3779B97F4A7C15)))
    order = np.argsort(h, kind="stable")
    s = h[order]
    same = np.zeros(len(h) + 1, bool)
    same[1:-1] = s[1:] == s[:-1]
    earlier, other = np.zeros(len(h), bool), np.zeros(len(h), bool)
    earlier[order] = same[:-1]
    other[order] = same[:-1] | same[1:]
    return earlier, other


class Texts:
    """Counts over some rows of a slice, made when first asked for."""

    def __init__(self, raw: np.ndarray, off: np.ndarray):
        self.raw, self.off = raw, off
        self._made: dict[str, np.ndarray] = {}

    def __getitem__(self, name: str) -> np.ndarray:
        if name not in self._made:
            getattr(self, "_" + name)()
        return self._made[name]

    def only(self, keep: np.ndarray) -> Texts:
        size = np.diff(self.off)
        out = Texts(self.raw[np.repeat(keep, size)], np.concatenate([[0], np.cumsum(size[keep])]))
        out._made = {k: v[keep] for k, v in self._made.items() if k in COUNTS}
        return out

    def _words(self) -> None:
        starts, ends, first = K.spans(~K.SPACE[self.raw], self.off)
        self._made |= {"starts": starts, "ends": ends, "first": first, "words": starts, "n_words": np.diff(first)}

    def __getattr__(self, name: str):
        if name in ("_n_words", "_first", "_starts", "_ends"):
            return self._words
        raise AttributeError(name)

    def _hash(self) -> None:
        self._made["hash"] = K.prefix_hash(self.raw)

    def _word_chars(self) -> None:
        self._made["word_chars"] = _sums(~K.SPACE[self.raw] & ((self.raw & 0xC0) != 0x80), self.off)

    def _n_symbols(self) -> None:
        self._made["n_symbols"] = _sums(_SYMBOL[self.raw], self.off)

    def _n_upper(self) -> None:
        self._made["n_upper"] = _sums(_UPPER[self.raw], self.off)

    def _n_letters(self) -> None:
        self._made["n_letters"] = _sums(_LETTER[self.raw] & ((self.raw & 0xC0) != 0x80), self.off)

    def _n_digits(self) -> None:
        self._made["n_digits"] = _sums(_DIGIT[self.raw], self.off)

    def _n_bangs(self) -> None:
        self._made["n_bangs"] = _sums(self.raw == 33, self.off)

    def _lines(self) -> None:
        """Lines with a word: how many, and how many equal an earlier one of their document."""
        starts, ends, first = K.spans(self.raw != 10, self.off)
        n = np.zeros(len(self.raw) + 1, np.int64)
        np.cumsum(~K.SPACE[self.raw], out=n[1:])
        real = n[ends] > n[starts]
        rows = np.repeat(np.arange(len(self.off) - 1), np.diff(first))[real]
        earlier, _ = _seen(K.span_hash(self["hash"], starts[real], ends[real]), rows)
        total = len(self.off) - 1
        self._made |= {"n_lines": np.bincount(rows, minlength=total), "n_dup_lines": np.bincount(rows[earlier], minlength=total)}

    _n_lines = _n_dup_lines = _lines

    def _word_hash(self) -> None:
        self._made["word_hash"] = K.span_hash(self["hash"], self["starts"], self["ends"])

    def _n_repeat_words(self) -> None:
        w, first = self["word_hash"], self["first"]
        rows = np.repeat(np.arange(len(self.off) - 1), np.diff(first))
        hit = np.zeros(len(w) + 2, bool)
        if len(w) > 2:
            at = np.flatnonzero(rows[2:] == rows[:-2])
            h = K.mix(K.mix(K.mix(w[at]) ^ w[at + 1]) ^ w[at + 2])
            _, other = _seen(h, rows[at])
            p = at[other]
            hit[p] = hit[p + 1] = hit[p + 2] = True
        self._made["n_repeat_words"] = np.bincount(rows[hit[: len(w)]], minlength=len(self.off) - 1)

    def _n_function(self) -> None:
        """Function words, their ASCII capitals lower-cased."""
        s = K.prefix_hash(K.LOWER[self.raw])
        h = K.span_hash(s, self["starts"], self["ends"])
        hit = np.isin(h, _function_hashes())
        rows = np.repeat(np.arange(len(self.off) - 1), np.diff(self["first"]))
        self._made["n_function"] = np.bincount(rows[hit], minlength=len(self.off) - 1)


COUNTS = ("n_words", "word_chars", "n_symbols", "n_upper", "n_letters", "n_digits", "n_bangs", "n_lines", "n_dup_lines", "n_repeat_words", "n_function")


def _function_hashes() -> np.ndarray:
    raw, off = K.string_bytes(pa.array(FUNCTION_WORDS))
    return np.unique(K.span_hash(K.prefix_hash(raw), off[:-1], off[1:]))


@dataclass(frozen=True)
class Rule:
    """rejects: from counts by name, where the rule rejects."""

    name: str
    rejects: Callable[[Texts], np.ndarray]


RULES = (
    Rule("symbols", lambda t: 10 * t["n_symbols"] > t["n_words"]),
    Rule("short_words", lambda t: t["word_chars"] < 3 * t["n_words"]),
    Rule("long_words", lambda t: t["word_chars"] > 12 * t["n_words"]),
    Rule("repeated_lines", lambda t: 100 * t["n_dup_lines"] > 60 * t["n_lines"]),
    Rule("capitals", lambda t: 100 * t["n_upper"] > 40 * t["n_letters"]),
    Rule("digits", lambda t: 100 * t["n_digits"] > 20 * t["word_chars"]),
    Rule("exclamations", lambda t: 2 * t["n_bangs"] > t["n_words"]),
    Rule("no_function_words", lambda t: t["n_function"] < 2),
)


def base_failed(t: Texts) -> np.ndarray:
    return (t["n_words"] < 50) | (100 * t["n_repeat_words"] > 50 * t["n_words"])


def cascade(t: Texts, rules: tuple[Rule, ...]) -> np.ndarray:
    """Which rows no rule rejects; a rule sees only what passed those before it."""
    alive = np.arange(len(t.off) - 1)
    kept = np.zeros(len(alive), bool)
    for rule in rules if len(alive) else ():
        out = rule.rejects(t)
        if out.any():
            alive, t = alive[~out], t.only(~out)
        if not len(alive):
            break
    kept[alive] = True
    return kept


def prepared(raw: np.ndarray, off: np.ndarray) -> tuple[Texts, np.ndarray, Texts]:
    """All texts with the base counts made, which of them the base rule rejects, and the others as the cascade meets them."""
    t = Texts(raw, off)
    bad = base_failed(t)
    for c in BASE[:5]:
        t[c]
    return t, bad, t.only(~bad)


def measured(texts: list[str], rules: tuple[Rule, ...] = RULES) -> list[tuple[float, int]]:
    """(seconds, rejections) of each rule on its own over the texts that pass the base rule."""
    told = [(0.0, 0)] * len(rules)
    for _, raw, off in K.slices(pa.array(texts, pa.string())):
        _, _, good = prepared(raw, off)
        for i, rule in enumerate(rules):
            mine = good.only(np.ones(len(good.off) - 1, bool))  # what other rules made stays with them
            began = time.perf_counter()
            gone = int(rule.rejects(mine).sum())
            told[i] = told[i][0] + time.perf_counter() - began, told[i][1] + gone
    return told


def rule_order(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES, rows: int = SAMPLE_ROWS) -> tuple[Rule, ...]:
    """Rules by rejections per second on a sample, most first.

    The sample is at most `rows` texts of at most SAMPLE_BYTES, one in twenty of as many partitions as it takes to find them: the
    limit is collected, so Spark reads a partition, then a few more, and no text moves between tasks.
    """
    some = docs.select(F.col(text).alias("text")).where(F.octet_length("text") <= SAMPLE_BYTES).sample(False, 0.05, 11)
    told = measured([r.text for r in some.limit(rows).collect()], rules)
    return tuple(rules[i] for i in sorted(range(len(rules)), key=lambda i: (-(told[i][1] + 0.5) / (told[i][0] + 1e-6), i)))


BASE_SCHEMA = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean"
BASE = [x.split()[0] for x in BASE_SCHEMA.split(", ")]


def quality(docs: DataFrame, keep_columns: list[str], text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """keep_columns of every row, with its base counts, base_failed and kept. A scan; nothing is shuffled."""
    ordered = rule_order(docs, text, rules)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parts = []
            for _, raw, off in K.slices(b.column(b.num_columns - 1)):
                t, bad, good = prepared(raw, off)
                kept = np.zeros(len(bad), bool)
                kept[~bad] = cascade(good, ordered)
                parts.append([*(t[c] for c in BASE[:5]), bad, kept])
            cols = [np.concatenate(x) for x in zip(*parts)] if parts else [np.zeros(0)] * 7
            arrays = [pa.array(c.astype(bool) if n in ("base_failed", "kept") else c.astype(np.int64)) for n, c in zip(BASE, cols)]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *arrays], [*b.schema.names[:-1], *BASE])

    return K.framed(docs, keep_columns, text, judge, BASE_SCHEMA)
