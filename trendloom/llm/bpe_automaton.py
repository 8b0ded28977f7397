"""Token counts by a deterministic transducer compiled from a SentencePiece BPE model.

BPE merges the best-ranked adjacent pair first (ties: leftmost). A sequence of pieces is the result for its text if and only if
each piece is the result for its own characters and each adjacent pair is the result for the pair's, so the last piece of
the result for text[:i] is the one piece that ends at i, and fits after the last piece of the result for what stands
before it. What text[:i] says about later counts is therefore: for each start j at which some piece may still be under way at
i, the last piece of text[:j], and how many tokens text[:j] has less than text[:i]. Those tuples are the automaton's
states; reading a character moves to the next state and is annotated with the change of the token count. States and
transitions are made when first met and kept by each worker: there are finitely many, as pieces are of bounded length.

A stretch of text is summarised by its state map: from the state before it to the state after it and the tokens emitted. Maps
compose associatively. No piece of a model of this kind has a word mark after another character, so wherever a word mark
follows a character that isn't one the automaton is in its start state whatever came before: a stretch between two such boundaries has a
constant map, one number, and the prefix scan over those is a running sum, which a task makes over all stretches of many rows
at once. Equal stretches have equal maps, so a map is looked up by the stretch's hash (and its bytes are compared with those of
the one it was made for). A stretch longer than CHUNK characters is cut into chunks with maps of their own, each
first asked for the state that reading the characters in front of it leads to; a scan composes them in rounds, and a map is asked
for another state only where that guess was wrong. Rows longer than PART bytes are counted part by part, cut at boundaries.

Null texts are empty and have no tokens. Special strings in a text are ordinary text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame

from . import kernel as K
from .nbest import unmarked

MODEL = "piece_bpe_32k.model"
MARK = "▁"
#: Characters of a chunk of a long stretch, and how many before it tell the state it is likely to start in.
CHUNK = 1 << 12
AHEAD = 64
#: Bytes of a part of a long row.
PART = 1 << 20
#: States (of some hundred bytes each) and pair tests that a worker keeps; beyond, they are made anew when met.
MAX_STATES = 300_000
MAX_FITS = 500_000
#: Stretches, and bytes of them, whose maps a worker keeps.
MAX_WORDS = 3_000_000
MAX_WORD_BYTES = 64 << 20
#: (characters under way, last piece before them, tokens before them less than now)
START = (("", "", 0),)


class Automaton:
    """Deterministic transducer over characters of marked text (spaces are word marks); state 0 is the start."""

    def __init__(self, model: str = MODEL):
        proc = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(model))
        size = proc.get_piece_size()
        names = [proc.id_to_piece(i) for i in range(size)]
        plain = [i for i in range(size) if not (proc.is_byte(i) or proc.is_control(i) or proc.is_unknown(i) or proc.is_unused(i))]
        #: Earlier merges have larger scores; equal scores merge leftmost first and need no order of their own.
        self.score = {names[i]: proc.get_score(i) for i in plain}
        if any(MARK in n.lstrip(MARK) for n in self.score):
            raise ValueError("a piece has a word mark after another character")
        self.begun = {n[:k] for n in self.score for k in range(1, len(n) + 1)}
        self.longest = max(map(len, self.score))
        self.fits: dict[tuple[str, str], bool] = {}
        self.flush()

    def flush(self) -> None:
        """Forget the states made so far; states are known by number inside run() only."""
        self.ids = {START: 0}
        self.states = [START]
        self.next: list[dict[str, tuple[int, int]]] = [{}]

    def number(self, entries: tuple) -> int:
        found = self.ids.get(entries)
        if found is None:
            found = self.ids[entries] = len(self.states)
            self.states.append(entries)
            self.next.append({})
        return found

    def merge(self, text: str) -> list[str]:
        """Plain BPE of a few characters (to compile transitions, never texts)."""
        found = list(text)
        while len(found) > 1:
            best = max(((self.score[p], -i) for i, p in enumerate(a + b for a, b in zip(found, found[1:])) if p in self.score), default=None)
            if best is None:
                break
            i = -best[1]
            found[i : i + 2] = [found[i] + found[i + 1]]
        return found

    def fit(self, left: str, right: str) -> bool:
        """Whether right follows left in the result for both together."""
        key = left, right
        found = self.fits.get(key)
        if found is None:
            found = self.fits[key] = self.merge(right) == [right] and (not left or self.merge(left + right) == [left, right])
        return found

    def step(self, state: int, char: str) -> tuple[int, int]:
        """(next state, change of the token count)."""
        known = self.next[state].get(char)
        if known is not None:
            return known
        # Of a state's entries (characters under way, last piece before them, tokens before them less than now), the first has none under way.
        old = self.states[state]
        last = None
        if char not in self.score:
            last, change = "\0", len(char.encode())  # bytes; they merge with nothing, so nothing is under way
            new = START
        else:
            for under, before, less in old:
                piece = under + char
                if piece in self.score and self.fit(before, piece):
                    last, change = piece, 1 - less
                    break
            if last is None:
                raise ValueError(f"no piece ends after {old!r} and {char!r}")
            entries = [("", last, 0)]
            for under, before, less in old:
                piece = under + char
                if piece in self.begun and len(piece) < self.longest:
                    entries.append((piece, before, less + change))
            new = tuple(entries)
        number = self.number(new)
        self.next[state][char] = number, change
        return number, change

    def run(self, state: tuple, text: str) -> tuple[tuple, int]:
        """(state after, tokens emitted) of marked text. Keeps within MAX_STATES and MAX_FITS, whatever the text's length."""
        count = 0
        for at in range(0, len(text), CHUNK):
            if len(self.states) > MAX_STATES:
                self.flush()
            if len(self.fits) > MAX_FITS:
                self.fits.clear()
            table, now = self.next, 0 if state is START else self.number(state)
            for c in text[at : at + CHUNK]:
                known = table[now].get(c)
                now, change = known if known is not None else self.step(now, c)
                count += change
            state = self.states[now]
        return state, count

    def emitted(self, state: tuple, char: str) -> int:
        """The change of the token count at a character, without the state after it."""
        if char not in self.score:
            return len(char.encode())
        for under, before, less in state:
            piece = under + char
            if piece in self.score and self.fit(before, piece):
                return 1 - less
        raise ValueError(f"no piece ends after {state!r} and {char!r}")

    def word(self, text: str) -> int:
        """Tokens of a stretch between boundaries, from the start state. What follows its last character is the start state again,
        so the state in between, which few other stretches share, isn't made."""
        if len(text) > CHUNK:
            return scan(chunk_maps(self, text, CHUNK), START)[1]
        state, count = self.run(START, text[:-1])
        return count + self.emitted(state, text[-1])


class ChunkMap:
    """State map of a chunk, known for the states it was asked for."""

    __slots__ = ("auto", "chunk", "known")

    def __init__(self, auto: Automaton, chunk: str, before: str):
        """before: the characters in front; what state they lead to is only a guess at what the chunk will be asked for."""
        self.auto, self.chunk, self.known = auto, chunk, {}
        self(auto.run(START, before)[0])

    def __call__(self, state: tuple) -> tuple[tuple, int]:
        found = self.known.get(state)
        if found is None:
            found = self.known[state] = self.auto.run(state, self.chunk)
        return found


class Composed:
    """The map of two neighbouring ones, known for the states that the first one knows."""

    __slots__ = ("first", "second", "known")

    def __init__(self, first: ChunkMap | Composed, second: ChunkMap | Composed):
        self.first, self.second, self.known = first, second, {}
        for state in list(first.known):
            self(state)

    def __call__(self, state: tuple) -> tuple[tuple, int]:
        found = self.known.get(state)
        if found is None:
            middle, one = self.first(state)
            after, two = self.second(middle)
            found = self.known[state] = after, one + two
        return found


def chunk_maps(auto: Automaton, text: str, chunk: int) -> list[ChunkMap]:
    return [ChunkMap(auto, text[i : i + chunk], text[max(0, i - AHEAD) : i]) for i in range(0, len(text), chunk)]


def scan(maps: list, state: tuple) -> tuple[tuple, int]:
    """Compose neighbouring maps in rounds, and ask the one of all for a state."""
    while len(maps) > 1:
        maps = [Composed(a, b) for a, b in zip(maps[::2], maps[1::2])] + maps[len(maps) & ~1 :]
    return maps[0](state)


def marked(text: str) -> str:
    """The model's own form of a text: a mark in front, spaces as marks."""
    return MARK + text.replace(" ", MARK) if text else ""


def count_text(auto: Automaton, text: str, chunk: int = CHUNK) -> int:
    """Tokens of one text, by the maps of its chunks alone."""
    t = marked(text)
    return scan(chunk_maps(auto, t, chunk), START)[1] if t else 0


class WordCounts:
    """Counts of known stretches by 64-bit hash, with their bytes; asks the automaton for new ones."""

    def __init__(self, auto: Automaton):
        self.auto = auto
        self.clear()

    def clear(self) -> None:
        self.known = K.Known(3)  # tokens, first byte, bytes
        self.data = K.Growing(np.uint8)

    def of(self, hashes: np.ndarray, flat: np.ndarray, size: np.ndarray, text_of) -> np.ndarray:
        """flat: the bytes of the stretches one after the other, `size` of each; text_of: a stretch's marked text."""
        if len(self.known) > MAX_WORDS or len(self.data) > MAX_WORD_BYTES:
            self.clear()
        each, first, back = np.unique(hashes, return_index=True, return_inverse=True)
        known, rows = self.known.find(each)
        fresh = np.flatnonzero(~known)
        begin = np.cumsum(size) - size
        if len(fresh):
            word, at = self.auto.word, first[fresh]
            n = size[at]
            rows[fresh] = np.stack([np.fromiter((word(text_of(i)) for i in at.tolist()), np.int64, len(at)), len(self.data) + np.cumsum(n) - n, n], 1)
            self.data.add(flat[K.ranges(begin[at], n)])
            self.known.add(each[fresh], rows[fresh])
        out, place, length = rows[back].T
        other = length != size
        if other.any() or not np.array_equal(self.data.values[K.ranges(place, length)], flat):  # two stretches have one hash
            out = out.copy()
            for i in range(len(out)):
                if other[i] or not np.array_equal(self.data.values[place[i] : place[i] + size[i]], flat[begin[i] : begin[i] + size[i]]):
                    out[i] = self.auto.word(text_of(i))
        return out


_KEPT: dict[str, WordCounts] = {}


def worker_counts(model: str) -> WordCounts:
    """The automaton of this worker process, kept between tasks."""
    if model not in _KEPT:
        _KEPT[model] = WordCounts(Automaton(model))
    return _KEPT[model]


def count_slice(counts: WordCounts, raw: np.ndarray, off: np.ndarray, begun: bool = False) -> np.ndarray:
    """Tokens of each row of a slice: its stretches start at the row's start and where a space follows a non-space.

    begun: the (only) row is a later part of a text, and starts at a boundary.
    """
    n = len(off) - 1
    if not len(raw):
        return np.zeros(n, np.int64)
    space = raw == 32
    cut = np.zeros(len(raw), bool)
    cut[1:] = space[1:] & ~space[:-1]
    cut[off[:-1][np.diff(off) > 0]] = True
    starts = np.flatnonzero(cut)
    ends = np.append(starts[1:], len(raw))
    first = np.searchsorted(starts, off)
    head = np.zeros(len(starts), bool)
    if not begun:
        head[first[:-1][np.diff(off) > 0]] = True
    # A row's first stretch has a mark in front, others have a space there: either is left out of what is hashed and compared.
    skip = ~head
    inner = np.ones(len(raw), bool)
    inner[starts[skip]] = False
    data = raw.tobytes()

    def text_of(i: int) -> str:
        return MARK + data[starts[i] + int(skip[i]) : ends[i]].decode("utf-8").replace(" ", MARK)

    got = counts.of(K.span_hash(K.prefix_hash(raw), starts + skip, ends), raw[inner], ends - starts - skip, text_of)
    total = np.concatenate([[0], np.cumsum(got)])
    return total[first[1:]] - total[first[:-1]]


def count_row(counts: WordCounts, raw: np.ndarray) -> int:
    """Tokens of one long row, in parts that start at boundaries; a part without one is a single stretch."""
    space = raw == 32
    ends = np.append(np.flatnonzero(space[1:] & ~space[:-1]) + 1, len(raw))
    total, at = 0, 0
    while at < len(raw):
        end = int(ends[min(max(np.searchsorted(ends, at + PART, "right") - 1, np.searchsorted(ends, at, "right")), len(ends) - 1)])
        part = raw[at:end]
        if len(part) > PART:  # one stretch
            text = part[int(at > 0) :].tobytes().decode()
            total += counts.auto.word(marked(text))
        else:
            total += int(count_slice(counts, part, np.array([0, len(part)]), at > 0)[0])
        at = end
    return total


def count_tokens(docs: DataFrame, keep_columns: list[str], text: str = "text", model: str = MODEL) -> DataFrame:
    """keep_columns of every row, n_bytes (UTF-8) and n_tokens. A scan; nothing is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = worker_counts(model)
        for b in batches:
            column = b.column(b.num_columns - 1)
            size, tokens = [np.diff(K.string_bytes(column)[1])], []
            for raw, off in unmarked(column, PART):  # a mark in a text stands for a space
                tokens.append(count_slice(counts, raw, off) if len(raw) <= PART else np.array([count_row(counts, raw)]))
            cols = [pa.array(np.concatenate(x) if x else np.zeros(0, np.int64), pa.int64()) for x in (size, tokens)]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *cols], [*b.schema.names[:-1], "n_bytes", "n_tokens"])

    return K.framed(docs, keep_columns, text, run, "n_bytes long, n_tokens long")
