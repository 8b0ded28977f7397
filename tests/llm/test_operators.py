"""Each operator against a plain version of itself, on small tables with awkward rows."""

import hashlib
import itertools
import os
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F

import public_tokenizers
from trendloom.llm import bpe_automaton, components, kernel, licenses, mixing, nbest, ngram_join, quality, queries, sketches, suffix_runs, toxicity, warc

WORD = re.compile("[^\x20\x09-\x0d]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, score string, id long, tag string, k0 int, n_tokens string, component string, mix_tokens int"
PASSAGE = "a passage of more than fifty bytes that stands in several of the documents here "


def texts():
    rng = random.Random(5)
    words = ["the", "of", "and", "house", "Über", "naïve", "x", "tree\t", "cat", "dog", "漢字", "😀", "stone.", "with", "is", "der", "die"]
    free = [" ".join(rng.choice(words) for _ in range(rng.randrange(1, 120))) for _ in range(30)]
    mixed = [free[i][:60] + PASSAGE + free[i + 1] for i in range(0, 12, 2)] + [PASSAGE, PASSAGE * 3]
    odd = [None, "", " \n\t ", "one", "ONE", "a b c", "\n".join(["same line here"] * 8), "x" * 49, "x" * 50, "ab" * 300, "▁literal mark ▁ ▁▁", "line\n\nline\n", "é \x00 <s> </s>"]
    long = " ".join(rng.choice(words) for _ in range(60_000))
    return free + mixed + odd + free[:6] + [free[0].upper(), long, long + " end", long]


@pytest.fixture(scope="module")
def docs(spark):
    """Null, empty, very long and repeated texts, null ids, repeated ids and rows, and columns named like results."""
    rows = [(i * 7 % 1009, t, "en" if i % 3 else None, None if i % 5 == 0 else f"s{i % 3}", len(t or ""), "k", None, i, "t", i, "n", "c", 1) for i, t in enumerate(texts())]
    rows += [(None, rows[0][1], *rows[0][2:]), (None, None, *[None] * 11), rows[3], rows[3], (rows[4][0], "another text under the same id, " + PASSAGE, *rows[4][2:])]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    return df.cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def by_text(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)


# ------------------------------------------------------------------ 1
def all_paths(p, text):
    def go(i):
        if i == len(text):
            yield 0, ()
            return
        for k, e, ids in p.edges(text, i):
            for s, more in go(k):
                yield s + e, ids + more

    return sorted(go(0), key=lambda x: (-x[0], x[1]))


def test_search_finds_the_best_paths_in_order():
    p, rng = nbest.Pieces(), random.Random(1)
    for _ in range(150):
        text = "".join(rng.choice("▁theinr😀 sa") for _ in range(rng.randrange(1, 9)))
        every = all_paths(p, text)
        found = p.search(text, 4)
        assert [s for s, _ in found] == [s for s, _ in every[:4]]
        assert set(found) <= set(every) and len(set(found)) == len(found)
        best, second, ids = p.forward(text)
        assert best[-1] == every[0][0] and (len(every) == 1 or second == every[1][0])
        assert sum(1 for x in every if x[0] == every[0][0]) > 1 or ids == every[0][1]


def test_nbest_of_a_text_and_round_trip(docs, empty):
    p = nbest.Pieces()
    out = nbest.encode(docs.where("length(text) < 12"), ["doc_id", "text", "k0"]).collect()
    for r in out:
        text = (r.text or "").replace("▁", " ")
        every = all_paths(p, "▁" + text.replace(" ", "▁")) if text else [(0, ())]
        assert r.scores == [s for s, _ in every[:4]]
        for option in r.nbest:
            ids = list(r.ids)
            for c in sorted(option.changes, key=lambda c: -c["at"]):
                ids[c["at"] : c["at"] + c["dropped"]] = c["ids"]
            assert nbest.decode_ids(p, np.array(ids, np.int64)).decode() == text
    whole = nbest.encode(docs, ["doc_id", "text"])
    assert whole.where("round_trip").count() == docs.count()
    back = nbest.decode(whole.withColumnRenamed("text", "was"), ["was"]).collect()
    assert all(r.text == (r.was or "").replace("▁", " ") for r in back)
    assert nbest.encode(empty, ["doc_id"]).count() == 0


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables")
def test_op1_tells_every_path(spark):
    p = nbest.Pieces()
    texts = {r.doc_id: (r.text or "").replace(nbest.MARK, " ") for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    rows = queries.op1_nbest_pieces(spark, "/root/testdata/sf0.001").collect()
    assert len(rows) == len(texts) and any(len(r.nbest) == 4 for r in rows)
    for r in rows:
        assert [x.score for x in r.nbest] == r.scores and r.n_pieces == len(r.ids)
        assert hashlib.sha256(np.array(r.ids, "<i4").tobytes()).hexdigest() == r.ids_sha256
        paths = set()
        for x in r.nbest:
            ids = list(r.ids)
            for c in sorted(x.changes, key=lambda c: -c["at"]):
                ids[c["at"] : c["at"] + c.dropped] = c.ids
            paths.add(tuple(ids))
            assert nbest.decode_ids(p, np.array(ids, np.int64)).decode() == texts[r.doc_id]
        assert len(paths) == len(r.nbest)


# ------------------------------------------------------------------ 2
def test_join_on_awkward_rows(docs, empty):
    from .test_join_fuzz import brute

    got = by_text(ngram_join.join(docs).select(F.coalesce("doc_id", F.lit(-1)).alias("d"), "n_shingles", F.coalesce("component_id", F.lit(-1)).alias("c")), "d", "n_shingles", "c")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    norm = [(i, " ".join(WORD.findall(t or ""))) for i, t in rows]
    assert got == sorted(brute(norm, 4, 85, 100), key=repr)
    assert ngram_join.join(empty).count() == 0


def test_prefixes_of_partners_share_enough():
    """The filter's claim, for every choice of lengths."""
    rng = np.random.default_rng(3)
    freq = rng.integers(1, 2000, ngram_join.SKETCH)
    for _ in range(40):
        n = int(rng.integers(5, 200))
        x = np.unique(rng.integers(0, 1 << 62, n).astype(np.uint64))
        y = x.copy()
        change = rng.integers(0, max(1, n // 20) + 1)
        y = np.unique(np.concatenate([y[change:], rng.integers(0, 1 << 62, change).astype(np.uint64)]))
        if 100 * len(np.intersect1d(x, y)) < 85 * len(np.union1d(x, y)):
            continue
        (mx, bx, px), (my, by, py) = (ngram_join.prefix(s, freq, 3.0, 85, 100) for s in (x, y))
        m = min(mx, my)
        assert len(set(px[: bx + m].tolist()) & set(py[: by + m].tolist())) >= m


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(300)] + [(1000 + i, 1000) for i in range(50)] + [(i, i + 1) for i in range(2000, 2060)] + [(5, 5)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for e in edges if e[0] != e[1] for x in e}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


# ------------------------------------------------------------------ 3
def test_toxicity_learns_words_and_prefixes(spark, empty):
    rng = random.Random(4)
    plain = [f"w{i}" for i in range(300)]
    rows, labels = [], []
    for i in range(900):
        w = [rng.choice(plain) for _ in range(rng.randrange(5, 60))]
        bad = i % 9 == 0
        if bad:
            for _ in range(3):
                w.insert(rng.randrange(len(w)), rng.choice(["scumword", "Vileterm", f"grunx{rng.choice(plain)}"]))
        rows.append((i, " ".join(w)))
        labels.append((i, int(bad) if rng.random() > 0.03 else int(not bad)))
    rows += [(901, None), (902, ""), (903, "scumword " * 30_000), (None, "vileterm vileterm")]
    labels += [(902, None), (None, 1), (0, 1)]
    d, lab = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    train = lab.where("doc_id % 4 <> 2")
    model = toxicity.fit(d, train)
    got = {r.doc_id: r.score for r in toxicity.score(d, model, ["doc_id"]).collect()}
    held = [i for i in range(900) if i % 4 == 2]
    assert np.mean([got[i] >= 0.3 for i in held if i % 9 == 0]) > 0.9
    assert np.mean([got[i] >= 0.3 for i in held if i % 9]) < 0.02
    assert got[901] == got[902] < 0.3 <= got[903] and got[None] >= 0.3
    none = toxicity.fit(d, train.where("toxic = 0"))
    assert toxicity.score(d, none, ["doc_id"]).select("score").distinct().count() == 1
    assert toxicity.score(empty, toxicity.fit(empty, train), ["doc_id"]).count() == 0


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="no test tables")
def test_held_out_labels(spark):
    """The given labels of the rows that were not learned from."""
    d = "/root/testdata/sf0.1"
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    held = [r for r in queries.op3_toxicity(spark, d).where("held_out").collect() if labels.get(r.doc_id) is not None]
    toxic, clean = ([r.predicted for r in held if labels[r.doc_id] == x] for x in (1, 0))
    assert len(toxic) > 50 and np.mean(toxic) > 0.8 and np.mean(clean) < 0.02
    assert all(zlib.crc32(str(r.doc_id).encode()) % 4 == 2 and 0 <= r.score <= 1 for r in held)


def test_other_columns_don_t_disturb_toxicity(docs, empty):
    names = [c for c in docs.columns if c != "text"]
    more = docs.selectExpr("*", "'x' AS toxic", "2 AS __id", "3 AS feature")
    model = toxicity.fit(more, docs.selectExpr("doc_id", "cast(doc_id % 3 = 0 AS int) AS toxic", "4 AS text", "5 AS __key"))
    plain = toxicity.fit(docs, docs.selectExpr("doc_id", "cast(doc_id % 3 = 0 AS int) AS toxic"))
    assert np.array_equal(model.known, plain.known) and np.allclose(model.weights, plain.weights)
    out = toxicity.score(more, model, [*names, "toxic", "__id"])
    assert out.columns == [*("score_in" if c == "score" else c for c in names), "toxic", "__id", "score"] and out.count() == docs.count()


def test_label_model_tells_good_voters_from_bad():
    rng = np.random.default_rng(0)
    truth = rng.random(3000) < 0.15
    good = (truth[:, None] & (rng.random((3000, 4)) < 0.7)) | (~truth[:, None] & (rng.random((3000, 4)) < 0.01))
    twin = good[:, :1]
    votes = np.concatenate([good, twin, twin], 1)
    given = np.where(rng.random(3000) < 0.05, ~truth, truth).astype(int)
    m = toxicity.label_model(votes, given)
    assert np.mean((m.posterior > 0.5) == truth) > np.mean((given > 0) == truth)
    assert m.share[0] < 0.5 < m.share[1]  # three copies of one voter share its evidence
    assert (m.fires[1, :4] > m.fires[0, :4]).all()


# ------------------------------------------------------------------ 4
def test_token_counts_equal_the_library(docs, empty):
    proc = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    for r in bpe_automaton.count_tokens(docs, ["doc_id", "text", "n_tokens"]).collect():
        assert (r.n_bytes, r.n_tokens) == (len((r.text or "").encode()), len(proc.encode(r.text or "")))
    assert bpe_automaton.count_tokens(empty, ["doc_id"]).count() == 0


def test_chunk_maps_compose():
    proc = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    auto, rng = bpe_automaton.Automaton(), random.Random(3)
    alphabet = [*"abcdehinorst  .AB", "é", "漢", "가", "😀", "\n", "the", "ing", " ▁", "▁", "    ", "\x00", "　"]
    for _ in range(400):
        t = "".join(rng.choice(alphabet) for _ in range(rng.randrange(0, 60)))
        n = len(proc.encode(t))
        assert [bpe_automaton.count_text(auto, t, c) for c in (1, 3, 17, 1000)] == [n] * 4
    text = "".join(rng.choice("abcdefghij") for _ in range(3000))
    a, b, c = bpe_automaton.chunk_maps(auto, text, 1000)
    left, right = (bpe_automaton.Composed(bpe_automaton.Composed(a, b), c), bpe_automaton.Composed(a, bpe_automaton.Composed(b, c)))
    states = {auto.run(bpe_automaton.START, x)[0] for x in ("a", "ab", "▁the", "漢")}
    assert all(left(s) == right(s) == auto.run(s, text) for s in states)
    auto.flush()
    assert bpe_automaton.count_text(auto, "hello world") == len(proc.encode("hello world"))


def unbroken():
    """Long texts without a space: letters, base64, CJK."""
    rng = random.Random(12)
    b64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    return ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=200_000)), "".join(rng.choices(b64, k=100_000)), "漢字仮名交じり文を書く。" * 8_000, "ab" * 60_000 + " end"]


def test_unbroken_texts_are_counted_by_chunk_maps(spark, monkeypatch):
    proc = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    counts, asked = bpe_automaton.WordCounts(bpe_automaton.Automaton()), []
    monkeypatch.setattr(bpe_automaton, "MAX_STATES", 5000)
    monkeypatch.setattr(bpe_automaton, "scan", lambda maps, state, scan=bpe_automaton.scan: asked.append(len(maps)) or scan(maps, state))
    for t in unbroken():
        raw = np.frombuffer(t.encode(), np.uint8)
        assert bpe_automaton.count_slice(counts, raw, np.array([0, len(raw)]))[0] == len(proc.encode(t))
        assert len(counts.auto.states) < 5000 + 2 * bpe_automaton.CHUNK
    assert len(asked) >= 4 and min(asked) > 20


def test_long_rows_are_counted_in_parts(monkeypatch):
    proc = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    counts = bpe_automaton.WordCounts(bpe_automaton.Automaton())
    for size in (7, 64, 1000):
        monkeypatch.setattr(bpe_automaton, "PART", size)
        for t in ["  the  cat sat " * 40, "x" * 300 + " y" * 50, " ", "word", "漢字 " * 30 + "a" * 200]:
            assert bpe_automaton.count_row(counts, np.frombuffer(t.encode(), np.uint8)) == len(proc.encode(t))


def thue_morse(n, a, b):
    return "".join((a, b)[bin(i).count("1") & 1] for i in range(n))


def test_strings_that_defeat_power_of_two_hashes():
    """A Thue-Morse string and its complement have one polynomial hash modulo any power of two."""
    one, two = thue_morse(1024, "a", "b"), thue_morse(1024, "b", "a")
    raw, off = kernel.string_bytes(pa.array([one, two]))
    assert len(set(kernel.span_hash(kernel.prefix_hash(raw), off[:-1], off[1:]).tolist())) == 2
    long, off = kernel.string_bytes(pa.array([one * 1500, two + one * 1499, "x" + one * 1500]))
    h = kernel.span_hash(kernel.prefix_hash(long), np.append(off[:-1], off[2] + 1), np.append(off[1:], off[3]))
    assert h[0] == h[3] != h[1]
    assert (quality.Texts(*kernel.string_bytes(pa.array([f"{one}\n{two}\n{one}"])))["n_dup_lines"] == [1]).all()


@pytest.mark.parametrize("hashes", ["real", "one"])
def test_equal_hashes_are_no_equal_texts(monkeypatch, hashes):
    """With one hash for all stretches, the caches of op1 and op4 still tell them apart by their bytes."""
    if hashes == "one":
        monkeypatch.setattr(kernel, "span_hash", lambda s, start, end: np.ones(len(start), np.uint64))
    proc = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    rows = [thue_morse(1024, "a", "b"), thue_morse(1024, "b", "a"), "the cat", "the dog sat", "", "x"]
    column = pa.array(rows)
    raw, off = kernel.string_bytes(column)
    counts = bpe_automaton.WordCounts(bpe_automaton.Automaton())
    assert [bpe_automaton.count_slice(counts, raw, off).tolist() for _ in range(2)] == [[len(proc.encode(t)) for t in rows]] * 2
    out = nbest.checked(nbest.Stretches(nbest.Pieces()), raw, off, nbest.BEST)
    want = [nbest.encode_slice(nbest.Stretches(nbest.Pieces()), *kernel.string_bytes(pa.array([t])), nbest.BEST, False)[0]["ids"].tolist() for t in rows]
    assert [m["ids"].tolist() for m, _ in out] == want and [t.decode() for _, t in out] == rows


def test_search_holds_little_memory():
    import tracemalloc

    p = nbest.Pieces()
    for t in unbroken()[:3]:
        tracemalloc.start()
        found = p.search(t, 4)
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < 300 * len(t) + (1 << 22)
        assert [s for s, _ in found] == sorted((s for s, _ in found), reverse=True) and len(set(found)) == len(found)
        assert all(p.decode(np.array(ids)).tobytes().decode() == t for _, ids in found)


# ------------------------------------------------------------------ 5
def passages(rows, size=50):
    """(bytes, removed, spans, digest) of each row."""
    least = {}
    for i, t in rows:
        b = (t or "").encode()
        if i is not None:
            for j in range(len(b) - size + 1):
                w = b[j : j + size]
                least[w] = min(least.get(w, i), i)
    out = []
    for i, t in rows:
        b = (t or "").encode()
        cov = bytearray(len(b))
        if i is not None:
            for j in range(len(b) - size + 1):
                if least[b[j : j + size]] < i:
                    cov[j : j + size] = b"\1" * size
        spans = sum(1 for j in range(len(b)) if cov[j] and not (j and cov[j - 1]))
        out.append((i, len(b), sum(cov), spans, hashlib.sha256(bytes(x for x, c in zip(b, cov) if not c)).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("hot", [False, True])
def test_passages(docs, empty, monkeypatch, hot):
    if hot:
        monkeypatch.setattr(suffix_runs, "HOT", 3)
        monkeypatch.setattr(suffix_runs, "HOT_IN_RUN", 2)
    d = docs.where("text is null or length(text) < 20000")
    got = by_text(suffix_runs.remove_repeats(d, ["doc_id", "id"]), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert got == passages([(r.doc_id, r.text) for r in d.collect()])
    assert suffix_runs.remove_repeats(empty, ["doc_id"]).count() == 0


def same_crc():
    """Two texts with one CRC-32 that share 88 bytes."""
    shared, seen, rng = "passage that stands in just these two texts and in no other of the table, 88 bytes long!", {}, random.Random(4)
    while True:
        t = shared + "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=10))
        was = seen.setdefault(zlib.crc32(t.encode()), t)
        if was != t:
            return was, t


@pytest.mark.parametrize("parts", [1, 2])
def test_texts_with_one_checksum(spark, parts):
    one, two = same_crc()
    rows = [(1, one), (2, two), (3, "something else " * 9), (4, "something else " * 9)]
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts, "doc_id")
    got = by_text(suffix_runs.remove_repeats(d, ["doc_id"]), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert got == passages(rows) and got[1][2] == 88


def test_windows_by_segments(monkeypatch):
    rng = np.random.default_rng(2)
    raw, off = rng.integers(97, 99, 5000).astype(np.uint8), np.array([0, 30, 100, 100, 2500, 2600, 5000])

    def starts(w):
        return {(r, i, p) for p, a, b, r in zip(w.p.tolist(), w.a.tolist(), w.b.tolist(), w.row.tolist()) for i in range(a, b + 1)}

    whole = starts(suffix_runs.Windows(raw, off, 50))
    assert {i for _, i, _ in whole} == {i for x, y in itertools.pairwise(off.tolist()) for i in range(x, y - 49)}
    for size in (1, 64, 999):
        monkeypatch.setattr(suffix_runs, "SEGMENT", size)
        assert starts(suffix_runs.Windows(raw, off, 50)) == whole


def test_long_passages_against_search_of_all(docs):
    """Texts over 20 000 characters, against a plain version."""
    rows = [(r.doc_id, r.text) for r in docs.where("length(text) > 20000").collect()]
    got = by_text(suffix_runs.remove_repeats(docs.where("length(text) > 20000"), ["doc_id"]), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert got == passages(rows)


def test_long_texts_keep_one_copy(docs):
    d = docs.where("length(text) > 20000")
    gone = sorted((r.doc_id, r.n_bytes - r.n_removed) for r in suffix_runs.remove_repeats(d, ["doc_id"]).collect())
    assert sum(left > 1000 for _, left in gone) == 1


def test_loser_tree_merges_front_coded_runs():
    rng = np.random.default_rng(1)
    for k in (1, 2, 3, 7):
        parts = []
        for _ in range(k):
            m = rng.integers(97, 99, (int(rng.integers(1, 60)), suffix_runs.WIDTH)).astype(np.uint8)
            m[:, 12:] = 97
            m[:, -1] = 0
            parts.append(m[np.argsort(suffix_runs.as_strings(m), kind="stable")])
        runs = [suffix_runs.Run(suffix_runs.pack_run(m, np.arange(len(m)), np.zeros(len(m)), np.zeros(len(m)))) for m in parts]
        assert all((r.matrix == m).all() for r, m in zip(runs, parts))
        got, agree = [], []
        for a, run, i in suffix_runs.merged(runs):
            got.append(run.matrix[i].tobytes())
            agree.append(a)
        assert got == sorted(x.tobytes() for m in parts for x in m)
        for (x, y), a in zip(itertools.pairwise(got), agree[1:]):
            shared = next((j for j in range(0, suffix_runs.WIDTH, 8) if x[j : j + 8] != y[j : j + 8]), suffix_runs.WIDTH)
            assert a * 8 == shared


def test_runs_are_cut_once_a_partition(spark, monkeypatch, tmp_path):
    """A task's run makes a piece for each partition, however many ranges a partition is merged in."""
    real, log, n = suffix_runs._blobs, tmp_path / "pieces", 16
    at = str(log)

    def counted(rows):
        with open(at, "a") as f:
            f.write("".join("p" for kind, *_ in rows if kind == 0))
        return real(rows)

    rng = random.Random(5)
    some = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz ", k=300)) for _ in range(24)]
    rows = [(i, "".join(rng.choices(some, k=4))) for i in range(64)]
    monkeypatch.setattr(suffix_runs, "_blobs", counted)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(n))
    try:
        d = spark.createDataFrame(rows, "doc_id long, text string").repartition(4, "doc_id")
        got = by_text(suffix_runs.remove_repeats(d, ["doc_id"]), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got == passages(rows)
    assert 4 * n <= len(log.read_text()) <= (4 + n) * n  # four tasks offer hashes, at most n offer windows


def test_hashes_of_minimisers_are_dealt_evenly():
    raw = np.random.default_rng(6).integers(0, 256, 300_000).astype(np.uint8)
    w = suffix_runs.Windows(raw, np.array([0, len(raw)]), 50)
    n = np.bincount(np.searchsorted(suffix_runs.hash_edges(20, 50 - suffix_runs.GRAM + 1), w.h, "right"), minlength=20)
    assert len(n) == 20 and n.min() > 0.85 * n.mean() and n.max() < 1.15 * n.mean()
    assert not len(suffix_runs.hash_edges(1, 27))


@pytest.mark.parametrize("k", [1, 5, 40])
def test_pieces_decoded_together_merge_by_range(k):
    rng = np.random.default_rng(3)
    pieces, every = [], []
    for _ in range(k):
        m = rng.integers(97, 99, (int(rng.integers(1, 60)), suffix_runs.WIDTH)).astype(np.uint8)
        m[:, 12:] = 97
        m[:, suffix_runs.WIDTH - 2], m[:, -1] = 1, 0
        m = m[np.argsort(suffix_runs.as_strings(m), kind="stable")]
        pieces.append(suffix_runs.pack_run(m, np.full(len(m), len(pieces)), np.arange(len(m)), np.arange(len(m))))
        every += [(x.tobytes(), len(pieces) - 1) for x in m]
    bounds = np.array([b"a" * 4 + b"b", b"ab", b"b" * 3], f"S{suffix_runs.WIDTH}")
    got = []
    for runs in suffix_runs.runs_by_range(pieces, bounds):
        got += [(run.matrix[i].tobytes(), run.ids[i]) for _, run, i in suffix_runs.merged(runs)]
    assert [x for x, _ in got] == sorted(x for x, _ in every) and sorted(got) == sorted(every)


# ------------------------------------------------------------------ 6
def test_mixing_keeps_all_and_meets_its_limits(docs, empty):
    out = mixing.mix(docs, docs.columns).collect()
    assert len({r.id for r in out}) == docs.select("id").distinct().count()
    plan = mixing.solve({"a": 1000, "b": 100, "c": 10, "d": 0})
    assert max(plan.epochs.values()) == pytest.approx(2.0) and min(plan.epochs.values()) == pytest.approx(1.0)
    flat = mixing.solve({"a": 1000, "b": 100, "c": 10}, repetition=None)
    assert flat.exponent == 0 and flat.weights["a"] == pytest.approx(1 / 3)
    target = mixing.solve({"a": 1000, "b": 100, "c": 10}, repetition=None, target_entropy=0.8)
    assert mixing.entropy(target.weights) == pytest.approx(0.8, abs=1e-9)
    assert mixing.mix(empty, ["doc_id"]).count() == 0


def test_cut_passes_meet_the_budget(spark):
    rng = random.Random(6)
    rows = [(i, f"{'w ' * rng.randrange(1, 30)}", "big" if i % 10 else "small") for i in range(2000)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = mixing.mix(d, ["doc_id"], repetition=1.5, block_tokens=500)
    read = {r.mix_source: (r.t, r.n) for r in out.groupBy("mix_source").agg(F.sum("mix_tokens").alias("t"), F.count("*").alias("n")).collect()}
    have = {s: sum(len(t.split()) for _, t, x in rows if x == s) for s in ("big", "small")}
    assert read["big"][0] == have["big"]
    assert read["small"][0] / have["small"] == pytest.approx(1.5, rel=0.03)


# ------------------------------------------------------------------ 7
def base_counts(t):
    w = WORD.findall(t)
    tri = list(zip(w, w[1:], w[2:]))
    hit = {p for i, x in enumerate(tri) if tri.count(x) > 1 for p in (i, i + 1, i + 2)} if len(tri) < 3000 else None
    seen, dup = set(), 0
    for line in t.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, None if hit is None else len(hit)


def test_quality_counts_and_order(docs, empty):
    out = quality.quality(docs, docs.columns).collect()
    assert len(out) == docs.count()
    for r in out:
        want = base_counts(r.text or "")
        got = (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words)
        assert got[:4] == want[:4] and want[4] in (None, got[4])
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.kept and r.base_failed) and r.kept_in in ("k", None)
    assert quality.quality(empty, ["doc_id"]).count() == 0


def test_rules_are_charged_what_the_cascade_pays(monkeypatch):
    """Base counts are made before rules are timed; a rule over them makes none."""
    made = []
    for name in ("_n_symbols", "_word_chars", "_lines", "_n_repeat_words", "_n_upper", "_n_function"):
        def spy(self, name=name, real=getattr(quality.Texts, name)):
            made.append(name)
            return real(self)

        monkeypatch.setattr(quality.Texts, name, spy)
    monkeypatch.setattr(quality.Texts, "_n_dup_lines", quality.Texts._lines)
    monkeypatch.setattr(quality.Texts, "_n_lines", quality.Texts._lines)
    good = [t for t in texts() if t and len(WORD.findall(t)) >= 60][:20]
    told = quality.measured(good)
    assert len(told) == len(quality.RULES) and made.count("_n_symbols") == made.count("_lines") == 1
    assert made.count("_n_upper") == made.count("_n_function") == 1
    assert quality.measured([]) == [(0.0, 0)] * len(quality.RULES)


def test_order_follows_rejections_per_second(spark, monkeypatch):
    monkeypatch.setattr(quality, "measured", lambda texts, rules: [(2.0, 1), (1.0, 9), (0.5, 0), (1.0, 9), (0.1, 5), (9.0, 9), (1.0, 1), (1.0, 0)])
    d = spark.createDataFrame([(1, "x")], "doc_id long, text string")
    order = [r.name for r in quality.rule_order(d)]
    want = sorted(range(8), key=lambda i: -[1.5 / 2, 9.5, 1.0, 9.5, 55, 9.5 / 9, 1.5, 0.5][i])
    assert order == [quality.RULES[i].name for i in want]


def test_cascade_order_doesn_t_change_the_verdict():
    raw, off = kernel.string_bytes(pa.array([t or "" for t in texts()]))
    verdicts = {tuple(quality.cascade(quality.Texts(raw, off), rules).tolist()) for rules in (quality.RULES, quality.RULES[::-1])}
    assert len(verdicts) == 1


# ------------------------------------------------------------------ 8
def test_licences(spark, docs, empty):
    rows = ["Licensed under the Apache License, Version 2.0.", "GNU General Public License; gnu general-public license", "released under the M1T licence", "under CC BY 4.0", "MIT\nlicense mit license", "submit licenses", "Creativ Commons Atribution", "x" * 100, "Licensed under CC BY-NC 4.0", None, "", "gnu lesser general public license"]
    d = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    got = {r.doc_id: r for r in licenses.scan(d, ["doc_id"]).collect()}
    told = [(got[i].n_base, got[i].base_labels, got[i].labels) for i in range(len(rows))]
    assert told == [
        (1, "apache", "apache"), (2, "gpl", "gpl"), (0, "", "mit"), (1, "cc-by", "cc-by"), (2, "mit", "mit"), (0, "", ""), (0, "", "cc-by"), (0, "", ""),
        (1, "cc-by", "cc-by,cc-by-nc"), (0, "", ""), (0, "", ""), (0, "", "lgpl"),
    ]
    assert (got[4].first_word, got[4].last_word, got[9].n_words, got[9].first_word) == (0, 2, 0, None)
    assert 0.8 < got[2].score < 1 and got[2].spans[0].edits == 2
    words = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    for r in licenses.scan(docs, ["doc_id", "text", "score"]).collect():
        assert r.n_words == len(words.findall((r.text or "").translate(LOWER)))
    assert licenses.scan(empty, ["doc_id"]).count() == 0


def least_edits(needle, hay):
    """The fewest insertions, deletions and substitutions that make a stretch of hay the needle."""
    row = [0] * (len(hay) + 1)
    for i, c in enumerate(needle, 1):
        new = [i]
        for j, d in enumerate(hay, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != d)))
        row = new
    return min(row)


def mangled(rng, phrase, edits):
    for _ in range(edits):
        at, kind = rng.randrange(len(phrase)), rng.randrange(3)
        phrase = phrase[:at] + (rng.choice("abcdeio ") if kind else "") + phrase[at + (kind != 1) :]
    return phrase


def test_licences_against_dynamic_programming(spark):
    """Base places by words, and the fewest edits of each notice by plain dynamic programming."""
    rng = random.Random(21)
    filler = "the code of this file is free to use and comes with no warranty under terms you may read in mit apache gnu by license".split()
    rows = []
    for _ in range(500):
        parts = [" ".join(rng.choice(filler) for _ in range(rng.randrange(0, 7))) for _ in range(2)]
        phrase, _ = rng.choice([*licenses.NOTICES, *licenses.BASE])
        rows.append(" ".join([parts[0], mangled(rng, phrase, rng.randrange(0, licenses.edits_for(phrase) + 2)), parts[1]]))
    rows = [r.title() if i % 3 == 0 else r for i, r in enumerate(rows)] + ["mit license", "cc by", "gnu general public license apache license"]
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string"), ["doc_id"]).collect()}
    several = 0
    for i, t in enumerate(rows):
        w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", t.translate(LOWER))
        base = [(at, label) for phrase, label in licenses.BASE for p in [phrase.split()] for at in range(len(w)) if w[at : at + len(p)] == p]
        places = [at for at, _ in base]
        assert (got[i].n_words, got[i].n_base, got[i].first_word, got[i].last_word) == (len(w), len(base), min(places, default=None), max(places, default=None))
        assert got[i].base_labels == ",".join(sorted({x for _, x in base}))
        hay = " ".join(w)
        near = [(e, label, len(p)) for p, label in licenses.NOTICES if (e := least_edits(p, hay)) <= licenses.edits_for(p)]
        labels = {x for _, x, _ in near}
        several += len(labels) > 1
        told = set(filter(None, got[i].labels.split(",")))
        assert {x for _, x in base} <= told <= labels | {x for _, x in base}
        if len(labels) == 1:
            assert told == labels | {x for _, x in base}
            assert got[i].score == (1.0 if base else pytest.approx(max(1 - e / n for e, _, n in near)))
        elif labels:
            assert {x for e, x, _ in near if e == min(near)[0]} & told
        else:
            assert got[i].score == (1.0 if base else 0.0)
    assert several > 5 and sum(bool(r.labels) for r in got.values()) > 200


def test_notice_at_the_start_of_a_text(spark):
    rows = [(0, "a licensex undr the apche license and more"), (1, "some words before a licensex undr the apche license and more")]
    got = {r.doc_id: r.labels for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string"), ["doc_id"]).collect()}
    assert got == {0: "apache", 1: "apache"}


# ------------------------------------------------------------------ 9
P61 = (1 << 61) - 1
M64 = (1 << 64) - 1


def plain_mix(h):
    h ^= h >> 30
    h = h * 0xBF58476D1CE4E5B9 & M64
    h ^= h >> 27
    h = h * 0x94D049BB133111EB & M64
    return h ^ h >> 31


def plain_sketch(text):
    """The fingerprint in plain Python: word hashes, five-word shingles, those under a quarter of 2**64, 24 bits of each."""
    words = [plain_mix(sum((c + 1) * pow(kernel.BASE, i, P61) for i, c in enumerate(w.encode())) % P61) for w in WORD.findall((text or "").translate(LOWER))]
    if not words:
        return b"", set()

    def chain(ws):
        h = 0
        for j, w in enumerate(ws):
            h = plain_mix(h ^ w ^ (j + 1))
        return h

    shingles = {chain(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {plain_mix(chain(words) ^ (0xABCD + len(words)))}
    digest = hashlib.blake2b(b"".join(w.to_bytes(8, "little") for w in words), digest_size=6).digest()
    return digest, {h >> 38 for h in shingles if h < 1 << 62}


def plain_likeness(a, b):
    if not a[1] or not b[1]:
        return float(a[0] == b[0])
    return len(a[1] & b[1]) / min(len(a[1]), len(b[1]))


def as_plain(code):
    digest, codes = sketches.decode(code)
    return digest, set(codes.tolist())


def test_sketch_against_next(docs, empty):
    d = docs.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    rows = sorted(((r.doc_id, r.text or "") for r in d.collect()), reverse=True)
    got = {r.doc_id: r for r in sketches.against_next(d).collect()}
    for (i, t), (_, after) in zip(rows, rows[1:] + rows[:1]):
        third = len(t) // 3
        e = t[: len(t) - third] + after[:third]
        assert (got[i].n_chars, got[i].edited_sha256) == (len(t), hashlib.sha256(e.encode()).hexdigest())
        own, edited, following = plain_sketch(t), plain_sketch(e), plain_sketch(after)
        assert (as_plain(got[i].fingerprint), as_plain(got[i].edited_fingerprint)) == (own, edited)
        assert (got[i].near_edited, got[i].near_next) == (plain_likeness(own, edited), plain_likeness(own, following))
    prints = {}
    for i, t in rows:
        assert prints.setdefault(t, got[i].fingerprint) == got[i].fingerprint
    assert sketches.against_next(empty).count() == 0
    assert sketches.against_next(docs).count() == docs.count()
    assert sketches.against_next(d.limit(1)).count() == 1
    other = d.select("doc_id", "text", F.lit(1).alias("fingerprint"), F.lit(2).alias("part"))
    assert sketches.against_next(other).count() == len(rows)
    assert sketches.fingerprint(other, other.columns).columns == ["doc_id", "text", "fingerprint_in", "part", "fingerprint"]


def test_sketches_merge_and_contain():
    rng = random.Random(8)
    word = lambda: f"w{rng.randrange(10**5)}"
    a, b = [word() for _ in range(4000)], [word() for _ in range(300)]
    part, whole = sketches.sketches(pa.array([" ".join(a[:400]), " ".join(a)]))
    assert sketches.containment(sketches.encode(part), sketches.encode(whole)) == 1.0
    one, two, both = (sketches.encode(x) for x in sketches.sketches(pa.array([" ".join(a), " ".join(b), " ".join(a) + " " + " ".join(b)])))
    joined = sketches.decode(sketches.merge(one, two))[1]
    assert len(np.setdiff1d(sketches.decode(both)[1], joined)) <= 4  # shingles across the seam
    half = sketches.encode(sketches.sketches(pa.array([" ".join(a[:2000] + b)]))[0])
    assert abs(sketches.containment(half, one) - 1996 / 2296) < 0.1


def test_short_texts_in_long_ones():
    """What a short text has under the threshold is found in any text that holds it; where it has none nothing is claimed."""
    rng = random.Random(9)
    long = [f"w{rng.randrange(10**4)}" for _ in range(2000)]
    whole = sketches.sketches(pa.array([" ".join(long)]))[0]
    told = []
    for _ in range(400):
        at = rng.randrange(1990)
        s = sketches.sketches(pa.array([" ".join(long[at : at + 8])]))[0]
        c = sketches.containment(sketches.encode(s), sketches.encode(whole))
        assert c == (1.0 if len(s[1]) else None) and sketches.likeness(s, whole) == (c or 0.0)
        told.append(c)
    assert told.count(1.0) > 200
    one, same, other = sketches.sketches(pa.array(["only Three words", "ONLY three  words", "three other words"]))
    assert sketches.likeness(one, same) == 1.0 and (one[0] == same[0]) and one[0] != other[0]
    none, blank = sketches.sketches(pa.array([None, " "]))
    assert sketches.likeness(none, blank) == 1.0 and sketches.likeness(none, one) == 0.0


# ------------------------------------------------------------------ 10
def test_warc_round_trip_and_lookup(spark, tmp_path):
    big, rng = "y" * 1500, random.Random(9)
    rows = [(i, f"http://www.Site{i % 5}.example.org:80/p/{i}?q={i % 3}", rng.choice([big, big + "é", "small", None, "", f"<p>{i}</p>" * 200])) for i in range(400)]
    rows += [(500, "http://a.b/ c\r\nd", big), (501, None, big), (None, "http://n.ull/", big), (502, "http://[bad", "z"), rows[7], (503, rows[8][1], "again")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    archive, index = f"file://{tmp_path}/a", f"file://{tmp_path}/i"
    manifest = warc.write_archives(pages, archive)
    directory = warc.build_index(manifest, index)
    assert [d[0] for d in directory] == sorted(d[0] for d in directory)
    best = {}
    for i, _, h in rows:
        if i is not None and len((h or "").encode()) >= 1000:
            best[h] = max(best.get(h, i), i)
    want = []
    for i, _, h in rows:
        b = (h or "").encode()
        first = best.get(h) if len(b) >= 1000 else None
        again = first is not None and (i is None or i < first)
        want.append((i, len(b), hashlib.sha1(b).hexdigest(), "revisit" if again else "response", first if again else None))
    got = [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.read_archives(spark, directory, index, archive).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    asked = spark.createDataFrame([(rows[8][1],), (rows[20][1],), ("http://nowhere/",), (None,)], "u string")
    found = sorted((r.page_id for r in warc.lookup(asked, "u", directory, index, archive).collect()), key=repr)
    assert found == sorted([8, 503, 20, 501], key=repr)
    none = warc.write_archives(pages.limit(0), archive)
    assert warc.read_archives(spark, warc.build_index(none, index), index, archive).count() == 0


def test_other_columns_don_t_disturb_archives(spark, tmp_path):
    big = "z" * 1200
    plain = spark.createDataFrame([(1, "http://a/", big), (2, None, big), (3, "http://a/", None), (3, "http://a/", None)], "page_id long, url string, html string")
    more = plain.selectExpr("*", "1 AS payload", "2 AS digest", "3 AS times", "4 AS best_id", "5 AS key", "6 AS refers_id", "7 AS file")
    told = []
    for i, pages in enumerate((plain, more)):
        archive, index = f"file://{tmp_path}/a{i}", f"file://{tmp_path}/i{i}"
        directory = warc.build_index(warc.write_archives(pages, archive), index)
        told.append(by_text(warc.read_captures(pages, directory, index, archive), "page_id", "record_type", "refers_to", "payload_bytes", "payload_digest"))
    assert told[0] == told[1] and [r[:3] for r in told[0]] == [(1, "revisit", 2), (2, "response", None), (3, "response", None), (3, "response", None)]


def test_the_query_bisects(spark, monkeypatch):
    """op10 reads the archives back by way of find(), which bisects the directory and a block, and reads ranges."""
    import inspect

    assert "read_captures" in inspect.getsource(queries.op10_warc_index) and "find(" in inspect.getsource(warc.read_captures)
    reads, keys = [], sorted(f"h)/{i:04d}" for i in range(1000))
    blocks = [[[k, "1", "f", "0", "9"] for k in keys[i : i + 10]] for i in range(0, 1000, 10)]

    class Index:
        def block(self, name, offset, length):
            reads.append(offset)
            return blocks[offset]

    directory = [(b[0][0], "f", i, 1) for i, b in enumerate(blocks)]
    assert [list(warc.find(k, directory, Index())) for k in ("h)/0537", "h)/none", "a")] == [[("f", 0, 9)], [], []]
    assert len(reads) <= 4


@pytest.mark.parametrize("lines", [2, 3000])
def test_addresses_with_spaces_are_found(spark, tmp_path, monkeypatch, lines):
    monkeypatch.setattr(warc, "BLOCK_LINES", lines)
    urls = [f"http://x/a{c}{d}" for c in (" ", "\u00a0", "\u3000", "z", "$", "%", "é", "") for d in "bcd"] * 2 + [None, ""]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("html", F.lit("x")).repartition(1)
    archive, index = f"file://{tmp_path}/a", f"file://{tmp_path}/i"
    directory = warc.build_index(warc.write_archives(pages, archive), index)
    want = sorted(range(len(urls)))
    asked = pages.select("url").distinct().where("url <> ''").unionByName(spark.createDataFrame([(None,)], "url string"))
    assert sorted(r.page_id for r in warc.lookup(asked, "url", directory, index, archive).collect()) == want
    assert sorted(r.page_id for r in warc.read_captures(pages, directory, index, archive).collect()) == want


def test_directory_stays_bounded(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "BLOCK_LINES", 10)
    monkeypatch.setattr(warc, "DIRECTORY_ENTRIES", 40)
    pages = spark.range(1000).select(F.col("id").alias("page_id"), F.concat(F.lit("http://h/"), F.col("id")).alias("url"), F.lit("x").alias("html"))
    directory = warc.build_index(warc.write_archives(pages, f"file://{tmp_path}/a"), f"file://{tmp_path}/i")
    assert 10 < len(directory) <= 40
    assert warc.read_archives(spark, directory, f"file://{tmp_path}/i", f"file://{tmp_path}/a").count() == 1000


# ------------------------------------------------------------------ kernel
def test_word_hashes_follow_words():
    rows = ["The cat sat", "cat", "sat on The cat", "", "a\x0bb c"]
    raw, off = kernel.string_bytes(pa.array(rows))
    h, starts, ends, first = kernel.words_of(raw, off)
    words = [w.lower() for t in rows for w in WORD.findall(t)]
    assert len(h) == len(words) and len(set(zip(h.tolist(), words))) == len(set(words)) == len(set(h.tolist()))
    assert zlib.crc32(raw.tobytes()) == zlib.crc32("".join(rows).encode())
