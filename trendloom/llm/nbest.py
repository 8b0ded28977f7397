"""N-best encoding with SentencePiece pieces, and decoding.

Each way to write a text as pieces of the model is a path of its piece lattice. A piece scores the logarithm of its rank
(Zipf's law over the model's merge order), in whole micro-nats so that sums are exact; a character outside the vocabulary is written
in byte pieces at a fixed charge. The forward pass finds for each node the best score from the start (Viterbi) and the
second best; those best scores are exact heuristics for an A-star search from the end backwards, which meets complete
paths in falling order of score without ever expanding a node that isn't on one of them.

No piece crosses the start of a word mark that follows another character, so the lattice of a text is a chain of stretches
joined at single nodes. A path with the n-th best score differs from the best in no stretch but the n - 1 with the smallest gaps
between best and second best, so the backward search runs there only; the others keep their best path. Stretches are
looked up by 64-bit hash in a bounded cache of each worker. Every row is decoded and held against its text; where two stretches
had one hash that shows, and the row is encoded again without the cache.

Null and empty texts have no pieces, score 0 and one empty path. Ties: equal paths of a stretch go in the order of the search,
equal gaps by position. Texts are encoded whole. A mark in a text is a space to the model, and decodes to one.
"""

from __future__ import annotations

import bisect
import hashlib
import heapq
import itertools
import math
from array import array
from collections.abc import Iterator, Sequence

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame

from . import kernel as K

MODEL = "piece_bpe_32k.model"
MARK = "▁"
BEST = 4
#: Charge of a byte piece, in micro-nats.
BYTE_SCORE = -14_000_000
_NONE = -(1 << 60)
#: Stretches that a worker keeps.
CACHE = 700_000
#: Rows whose marks are replaced at a time.
ROWS = 500
#: Characters from which on a stretch's scores go to arrays.
LONG = 4096


class Pieces:
    def __init__(self, model: str = MODEL):
        proc = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(model))
        size = proc.get_piece_size()
        self.score: dict[str, tuple[int, int]] = {}
        self.byte: dict[int, int] = {}
        text: list[bytes] = []
        for i in range(size):
            name = proc.id_to_piece(i)
            text.append(b"" if proc.is_control(i) or proc.is_unknown(i) else name.replace(MARK, " ").encode())
            if proc.is_byte(i):
                value = int(name[3:5], 16)
                self.byte[value], text[i] = i, bytes([value])
            elif text[i]:
                rank = -proc.get_score(i)
                self.score[name] = (-round(1e6 * math.log((rank if rank < 1e8 else 1) + 2)), i)
        self.longest = max(map(len, self.score))
        #: The score of a piece, 1 of what only begins pieces.
        self.table = {n[:k]: 1 for n in self.score for k in range(1, len(n))} | {n: e for n, (e, _) in self.score.items()}
        self.starts = np.concatenate([[0], np.cumsum([len(t) for t in text])])
        self.text = np.frombuffer(b"".join(text), np.uint8)

    def edges(self, text: str, i: int) -> Iterator[tuple[int, int, tuple[int, ...]]]:
        """(end, score, ids) of what may stand from character i."""
        if text[i] not in self.score:
            data = text[i].encode()
            yield i + 1, BYTE_SCORE * len(data), tuple(self.byte[b] for b in data)
            return
        for k in range(i + 1, len(text) + 1):
            piece = text[i:k]
            if piece not in self.table:
                return
            found = self.score.get(piece)
            if found:
                yield k, found[0], found[1:]

    def forward(self, text: str) -> tuple[Sequence[int], int, tuple[int, ...]]:
        """Best score from the start to each node; the second best score to the end; the best path."""
        n, get = len(text), self.table.get
        none = [_NONE] if n < LONG else array("q", [_NONE])  # short lists are faster, long ones take four times the memory
        best, second, back = none * (n + 1), none * (n + 1), none * (n + 1)
        best[0] = 0
        for i in range(n):
            b, s, k = best[i], second[i], i + 1
            e = get(text[i])
            if e is None or e > 0:
                e = BYTE_SCORE * len(text[i].encode())
                last = k
            else:
                last = n
            while True:
                if e <= 0:
                    t = b + e
                    old = best[k]
                    if t > old:
                        s_e = s + e
                        second[k] = old if old > s_e else s_e
                        best[k], back[k] = t, i
                    elif t > second[k]:
                        second[k] = t
                if k == last:
                    break
                k += 1
                e = get(text[i:k])
                if e is None:
                    break
        cuts = [n]
        while cuts[-1]:
            cuts.append(back[cuts[-1]])
        cuts.reverse()
        ids: list[int] = []
        for i, k in itertools.pairwise(cuts):
            found = self.score.get(text[i:k])
            if found is not None:
                ids.append(found[1])
            else:
                ids.extend(self.ids_of(text[i:k]))
        return best, second[n], tuple(ids)

    def ids_of(self, piece: str) -> tuple[int, ...]:
        """The id of a piece, or the byte pieces of a character outside the vocabulary."""
        found = self.score.get(piece)
        return found[1:] if found else tuple(self.byte[x] for x in piece.encode())

    def search(self, text: str, count: int) -> list[tuple[int, tuple[int, ...]]]:
        """The `count` best (score, ids), by A-star from the end with the forward scores as heuristics.

        As the heuristics are exact, each open entry has a complete path of just its estimate, and no two entries have a
        path in common. So only as many of the best entries as paths are still asked for need be kept open, and what is
        held is `count` chains of places. Paths that tie come in the order of the search, which depends on the text only.
        """
        best, get = self.forward(text)[0], self.score.get
        order = itertools.count()
        open_: list[tuple] = [(-best[-1], next(order), len(text), 0, None)]  # falling estimate; place, score from there on, (place, chain)
        out: list[tuple[int, tuple[int, ...]]] = []
        while open_ and len(out) < count:
            _, _, k, done, chain = open_.pop(0)
            chain = k, chain
            if k == 0:
                ids: list[int] = []
                at, rest = chain
                while rest:
                    ids.extend(self.ids_of(text[at : rest[0]]))
                    at, rest = rest
                out.append((done, tuple(ids)))
                continue
            room = count - len(out)
            if get(text[k - 1]) is None:
                step = [(k - 1, BYTE_SCORE * len(text[k - 1].encode()))]
            else:
                step = [(i, found[0]) for i in range(max(0, k - self.longest), k) if (found := get(text[i:k])) and get(text[i])]
            for i, e in step:
                told = -(done + e + best[i])
                if len(open_) < room or told < open_[-1][0]:
                    bisect.insort(open_, (told, next(order), i, done + e, chain))
                    del open_[room:]
        return out

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """Bytes of a run of pieces; the mark in front of a text is its first byte."""
        size = np.diff(self.starts)[ids]
        return self.text[K.ranges(self.starts[ids], size)]


class Stretches:
    """Of known stretches by hash: best score, gap to the second, and the best path's ids."""

    def __init__(self, pieces: Pieces):
        self.pieces = pieces
        self.clear()

    def clear(self) -> None:
        self.known = K.Known(4)  # score, gap, first id, ids
        self.ids = K.Growing(np.int32)

    def of(self, hashes: np.ndarray, text_of) -> np.ndarray:
        """Rows of the stretches; their id ranges hold until the next call."""
        if len(self.known) > CACHE:
            self.clear()
        each, first, back = np.unique(hashes, return_index=True, return_inverse=True)
        known, rows = self.known.find(each)
        fresh = np.flatnonzero(~known)
        if len(fresh):
            made, flat, place = [], [], len(self.ids)
            for i in first[fresh].tolist():
                best, second, ids = self.pieces.forward(text_of(i))
                made.append((best[-1], best[-1] - second if second > _NONE // 2 else -_NONE, place, len(ids)))
                flat.extend(ids)
                place += len(ids)
            self.ids.add(np.array(flat, np.int32))
            rows[fresh] = made
            self.known.add(each[fresh], rows[fresh])
        return rows[back]


_KEPT: dict[str, Stretches] = {}


def worker_stretches(model: str) -> Stretches:
    if model not in _KEPT:
        _KEPT[model] = Stretches(Pieces(model))
    return _KEPT[model]


def best_sums(options: list[list[int]], count: int) -> list[tuple[int, tuple[int, ...]]]:
    """The `count` smallest sums of one loss from each list, and the places chosen."""
    every = ((sum(o[c] for o, c in zip(options, choice)), choice) for choice in itertools.product(*(range(len(o)) for o in options)))
    return heapq.nsmallest(count, every)


def encode_slice(known: Stretches, raw: np.ndarray, off: np.ndarray, count: int, by_hash: bool = True) -> list[dict]:
    """For each row: ids (best path), nbest: [(score, [(first id, ids replaced, new ids), ...]), ...].

    Without by_hash, no stretch is taken for equal to another.
    """
    rows = len(off) - 1
    real = np.diff(off) > 0
    space = raw == 32
    cut = np.zeros(len(raw) + 1, bool)
    if len(raw):
        cut[1:-1] = space[1:] & ~space[:-1]
    cut[off[:-1][real]] = True
    starts = np.flatnonzero(cut[: len(raw)])
    ends = np.append(starts[1:], len(raw)) if len(starts) else starts
    first = np.searchsorted(starts, off)
    head = np.zeros(len(starts), bool)
    head[first[:-1][real]] = True
    if by_hash:
        plain = K.span_hash(K.prefix_hash(raw), starts, ends)
        hashes = np.where(head, K.mix(plain + K.U(1)), plain)
    else:
        hashes = np.arange(len(starts), dtype=K.U)
    data = raw.tobytes()

    def text_of(i: int) -> str:
        t = data[starts[i] : ends[i]].decode().replace(" ", MARK)
        return MARK + t if head[i] else t

    told = known.of(hashes, text_of) if len(starts) else np.zeros((0, 4), np.int64)
    score, gap, place, size = told.T
    ends_ids = np.cumsum(size)
    flat = known.ids.values[K.ranges(place, size)]
    begin = np.concatenate([[0], ends_ids])
    total = np.concatenate([[0], np.cumsum(score)])
    out = []
    for r in range(rows):
        a, b = int(first[r]), int(first[r + 1])
        best = int(total[b] - total[a])
        g = gap[a:b]
        near = np.argsort(g, kind="stable")[: count - 1] if len(g) <= 64 else _smallest(g, count - 1)
        near = sorted(int(i) + a for i in near if g[i] < -_NONE)
        paths = [_led(known.pieces.search(text_of(i), count), flat[begin[i] : begin[i + 1]].tolist()) for i in near]
        nbest = []
        for loss, choice in best_sums([[p[0][0] - x for x, _ in p] for p in paths], count):
            nbest.append((best - loss, [(int(begin[i] - begin[a]), int(size[i]), list(p[c][1])) for i, p, c in zip(near, paths, choice) if c]))
        out.append({"ids": flat[begin[a] : begin[b]], "nbest": nbest})
    return out


def _led(paths: list[tuple], best: list[int]) -> list[tuple]:
    """The paths with the one that was taken as the best in front; where several score alike the search may put another first."""
    others = [p for p in paths if list(p[1]) != best]
    return [(paths[0][0], best), *others][: len(paths)]


def _smallest(g: np.ndarray, n: int) -> np.ndarray:
    """Places of the n smallest, equal ones by position."""
    edge = np.partition(g, n - 1)[n - 1]
    at = np.flatnonzero(g <= edge)
    return at[np.argsort(g[at], kind="stable")[:n]]


def unmarked(column: pa.Array, limit: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(bytes, offsets) of runs of rows, marks in the texts as spaces; a few rows are made over at a time."""
    for i in range(0, len(column), ROWS):
        for _, raw, off in K.slices(pc.replace_substring(column.slice(i, ROWS).fill_null(""), MARK, " "), limit):
            yield raw, off


def checked(known: Stretches, raw: np.ndarray, off: np.ndarray, count: int) -> list[tuple[dict, bytes]]:
    """encode_slice with each row's decoded bytes; a row that doesn't decode to itself met a stretch of the same hash and is encoded again."""
    out = []
    data = raw.tobytes()
    for i, m in enumerate(encode_slice(known, raw, off, count)):
        t = decode_ids(known.pieces, m["ids"])
        if t != data[off[i] : off[i + 1]]:
            m = encode_slice(Stretches(known.pieces), raw[off[i] : off[i + 1]], np.array([0, off[i + 1] - off[i]]), count, False)[0]
            t = decode_ids(known.pieces, m["ids"])
        out.append((m, t))
    return out


def decode_ids(pieces: Pieces, ids: np.ndarray) -> bytes:
    return pieces.decode(ids).tobytes()[1:]


NBEST = pa.list_(pa.struct([("score", pa.int64()), ("changes", pa.list_(pa.struct([("at", pa.int32()), ("dropped", pa.int32()), ("ids", pa.list_(pa.int32()))])))]))
SCHEMA = "ids array<int>, n_pieces long, scores array<bigint>, nbest array<struct<score:bigint,changes:array<struct<at:int,dropped:int,ids:array<int>>>>>, ids_sha256 string, decoded_sha256 string, round_trip boolean"


def encode(docs: DataFrame, keep_columns: list[str], text: str = "text", count: int = BEST, model: str = MODEL) -> DataFrame:
    """keep_columns of every row, its best path, the scores of the `count` best, how the others differ from the best
    (from id `at` on, `dropped` ids make way for `ids`), digests of the ids and of the text decoded from them, and whether
    that is the text. A scan; nothing is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = worker_stretches(model)
        for b in batches:
            kept = b.columns[:-1]
            at = 0
            for raw, off in unmarked(b.column(b.num_columns - 1), 2 * K.SLICE):  # each slice looks all its stretches up at once
                made, texts = zip(*checked(known, raw, off, count))
                lens = np.array([len(m["ids"]) for m in made])
                flat = np.concatenate([m["ids"] for m in made]) if len(made) else np.zeros(0, np.int32)
                data = raw.tobytes()
                cols = [
                    pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lens)]), pa.int32()), pa.array(flat, pa.int32())),
                    pa.array(lens, pa.int64()),
                    pa.array([[s for s, _ in m["nbest"]] for m in made], pa.list_(pa.int64())),
                    pa.array([[{"score": s, "changes": [{"at": x, "dropped": y, "ids": z} for x, y, z in c]} for s, c in m["nbest"]] for m in made], NBEST),
                    pa.array([hashlib.sha256(m["ids"].astype("<i4").tobytes()).hexdigest() for m in made]),
                    pa.array([hashlib.sha256(t).hexdigest() for t in texts]),
                    pa.array([t == data[off[i] : off[i + 1]] for i, t in enumerate(texts)], pa.bool_()),
                ]
                n = len(made)
                yield pa.RecordBatch.from_arrays([*(c.slice(at, n) for c in kept), *cols], [*b.schema.names[:-1], *NAMES])
                at += n

    return K.framed(docs, keep_columns, text, run, SCHEMA)


NAMES = ["ids", "n_pieces", "scores", "nbest", "ids_sha256", "decoded_sha256", "round_trip"]


def decode(coded: DataFrame, keep_columns: list[str], ids: str = "ids", model: str = MODEL) -> DataFrame:
    """keep_columns of every row and the text of its ids (null ids: empty). Bytes that aren't UTF-8 become U+FFFD."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = worker_stretches(model).pieces
        for b in batches:
            texts = [decode_ids(pieces, np.array(x, np.int64)).decode("utf-8", "replace") if x else "" for x in b.column(b.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(texts, pa.string())], [*b.schema.names[:-1], "text"])

    return K.framed(coded, keep_columns, ids, run, "text string")
