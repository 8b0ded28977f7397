"""Document fingerprints by a fixed hash threshold.

A text's sketch keeps every distinct hash of its five-word shingles (ASCII capitals lower-cased; a text of one to four
words is one shingle) that lies under 2**64 / SCALE. It grows with the text, so a short text's containment in a
far longer one can be estimated, and the sketch of texts together is the union of their sketches.

A fingerprint is written as the digest of the text's whole word sequence (48 bits) and the first 24 bits under the threshold of
each hash kept, sorted, in base 64. All likenesses are those of fingerprints as written, so they can be told from what is stored;
codes of 24 bits make a shingle agree by chance in n / 2**24 of cases with a sketch of n.

Likeness is the larger of the two containments, that is, that of the smaller sketch in the larger. A text of few words may have
no hash under the threshold; with such a one nothing can be estimated, and likeness is 1 if the digests agree and else 0.
Null, empty and wordless texts have the empty fingerprint, which is alike to itself (1) and to no other (0). Equal texts have equal
fingerprints. Merged fingerprints have no digest of their own (zeros).
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel as K
from .storage import cut, partitions

SHINGLE = 5
SCALE = 4
_LIMIT = K.U((1 << 64) // SCALE)
#: Bytes of a code and of the digest.
CODE, DIGEST = 3, 6
_SHIFT = K.U(64 - (SCALE - 1).bit_length() - 8 * CODE)


def _bytes(codes: np.ndarray) -> bytes:
    return codes.astype(">u4").view(np.uint8).reshape(-1, 4)[:, 1:].tobytes()


def _codes(packed: bytes) -> np.ndarray:
    out = np.zeros((len(packed) // CODE, 4), np.uint8)
    out[:, 1:] = np.frombuffer(packed, np.uint8, len(out) * CODE).reshape(-1, CODE)
    return out.view(">u4").ravel().astype(np.uint32)


def sketches(texts: pa.Array, k: int = SHINGLE) -> list[tuple[bytes, np.ndarray]]:
    """For each text its digest (empty: no words) and the sorted codes of the hashes under the threshold."""
    out = []
    for _, raw, off in K.slices(texts):
        words, _, _, first = K.words_of(raw, off)
        h, at = K.shingle_hashes(words, first, k)
        low = np.flatnonzero(h < _LIMIT)
        cuts = np.searchsorted(low, at)
        kept = (h[low] >> _SHIFT).astype(np.uint32)
        for r in range(len(off) - 1):
            mine = words[first[r] : first[r + 1]]
            digest = hashlib.blake2b(mine.tobytes(), digest_size=DIGEST).digest() if len(mine) else b""
            out.append((digest, np.unique(kept[cuts[r] : cuts[r + 1]])))
    return out


def encode(sketch: tuple[bytes, np.ndarray]) -> str:
    return base64.b64encode(sketch[0] + _bytes(sketch[1])).decode()


def decode(code: str) -> tuple[bytes, np.ndarray]:
    packed = base64.b64decode(code)
    return packed[:DIGEST], _codes(packed[DIGEST:])


def merge(a: str, b: str) -> str:
    """The fingerprint of two texts' shingles together."""
    x, y = decode(a)[1], decode(b)[1]
    return encode((bytes(DIGEST), np.union1d(x, y)))


def containment(a: str, b: str) -> float | None:
    """How much of a's text stands in b's; None where a's sketch is empty, which tells nothing."""
    x, y = decode(a)[1], decode(b)[1]
    return len(np.intersect1d(x, y, assume_unique=True)) / len(x) if len(x) else None


def likeness(a: tuple[bytes, np.ndarray], b: tuple[bytes, np.ndarray]) -> float:
    """Containment of the smaller sketch in the larger; where either is empty, whether the texts have one digest."""
    if not len(a[1]) or not len(b[1]):
        return float(a[0] == b[0])
    return len(np.intersect1d(a[1], b[1], assume_unique=True)) / min(len(a[1]), len(b[1]))


def fingerprint(docs: DataFrame, keep_columns: list[str], text: str = "text", k: int = SHINGLE) -> DataFrame:
    """keep_columns of every row and its fingerprint. A scan; nothing is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            codes = [encode(s) for s in sketches(b.column(b.num_columns - 1), k)]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(codes, pa.string())], [*b.schema.names[:-1], "fingerprint"])

    return K.framed(docs, keep_columns, text, run, "fingerprint string")


#: kind 0: a result, the edited fingerprint as bits of which own codes it has and the digest and codes besides; kinds 1 and 2: a part's first and last document.
_SCHEMA = "kind int, part int, doc_id long, text string, n_chars long, edited_sha256 binary, own binary, shared binary, besides binary, near_edited double, near_next double"
_TYPES = [pa.int32(), pa.int32(), pa.int64(), pa.string(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.binary(), pa.float64(), pa.float64()]
_NAMES = [x.split()[0] for x in _SCHEMA.split(", ")]


def edited_text(text: str, after: str) -> str:
    """text with its last third replaced by the beginning of the next one."""
    third = len(text) // 3
    return text[: len(text) - third] + after[:third]


def _compare(ids: list, texts: list[str], k: int) -> list[tuple]:
    """A result row for each text but the last, which is only the next of the one before it."""
    edited = [edited_text(t, after) for t, after in zip(texts, texts[1:])]
    own, other = sketches(pa.array(texts, pa.string()), k), sketches(pa.array(edited, pa.string()), k)
    out = []
    for i, t, e, s, x, n in zip(ids, texts, edited, own, other, own[1:]):
        shared = np.packbits(np.isin(s[1], x[1], assume_unique=True)).tobytes()
        besides = x[0] + _bytes(np.setdiff1d(x[1], s[1], assume_unique=True))
        out.append((0, None, i, None, len(t), hashlib.sha256(e.encode()).digest(), s[0] + _bytes(s[1]), shared, besides, likeness(s, x), likeness(s, n)))
    return out


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows)) or [[]] * len(_NAMES)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, _TYPES)], _NAMES)


_RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Results with both fingerprints written out."""
    for b in batches:
        own, edited = [], []
        for mine, shared, besides in zip(*(b.column(c).to_pylist() for c in ("own", "shared", "besides"))):
            codes = _codes(mine[DIGEST:])
            kept = codes[np.unpackbits(np.frombuffer(shared, np.uint8), count=len(codes)).astype(bool)]
            own.append(base64.b64encode(mine).decode())
            edited.append(encode((besides[:DIGEST], np.union1d(kept, _codes(besides[DIGEST:])))))
        digests = [x.hex() for x in b.column("edited_sha256").to_pylist()]
        cols = [b.column("doc_id"), b.column("n_chars"), pa.array(digests, pa.string()), pa.array(own, pa.string()), pa.array(edited, pa.string()), b.column("near_edited"), b.column("near_next")]
        yield pa.RecordBatch.from_arrays(cols, [x.split()[0] for x in _RESULT.split(", ")])


def against_next(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = SHINGLE) -> DataFrame:
    """Each document's fingerprint, its likeness to its edited text's and to the next document's, in descending order of ids.

    Ties of ids follow the order of texts, null ids come last; the document after the last is the first (a lone
    document is its own next). Documents are range-partitioned once; each part passes on its first and last
    document, and the last of a part meets the first of the next part that has any, pair by pair, in tasks of their own.
    """
    none = (None,) * 7

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None
        part = TaskContext.get().partitionId()
        for b in batches:
            ids, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            if not ids:
                continue
            if held is None:
                yield _batch([(1, part, ids[0], texts[0], *none)])
            else:
                ids, texts = [held[0], *ids], [held[1], *texts]
            at = 0
            while at < len(ids) - 1:
                size, end = 0, at
                while end < len(ids) - 1 and (end == at or size < K.SLICE):
                    size += len(texts[end])
                    end += 1
                yield _batch(_compare(ids[at:end], texts[at : end + 1], k))
                at = end
            held = ids[-1], texts[-1]
        if held is not None:
            yield _batch([(2, part, *held, *none)])

    def join_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple | None = None
        for b in batches:
            for kind, i, t in zip(*(b.column(c).to_pylist() for c in ("kind", "doc_id", "text"))):
                if kind == 2:
                    last = i, t
                else:
                    yield _batch(_compare([last[0]], [last[1], t], k))

    picked = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    order = [F.col("doc_id").desc_nulls_last(), F.col("text")]
    made = cut(picked.repartitionByRange(order[0]).sortWithinPartitions(*order).mapInArrow(K.lean(run), _SCHEMA), "sketches")
    ends = made.where("kind > 0").select("kind", "part", "doc_id", "text")
    parts = sorted(r.part for r in ends.where("kind = 1").select("part").collect())  # a number for each task
    before = docs.sparkSession.createDataFrame(list(zip(parts, [*parts[-1:], *parts])), "part int, before int")
    paired = ends.join(F.broadcast(before), "part").withColumn("pair", F.when(F.col("kind") == 1, F.col("before")).otherwise(F.col("part")))
    met = paired.repartition(max(1, min(len(parts), partitions(docs.sparkSession))), "pair").sortWithinPartitions("pair", F.desc("kind"))
    told = made.where("kind = 0").unionByName(met.select("kind", "doc_id", "text").mapInArrow(K.lean(join_ends), _SCHEMA))
    return told.mapInArrow(K.lean(_written), _RESULT)
