"""Near copies by random edits: components against brute force."""

import os
import random

import pytest

from trendloom.llm import ngram_join


def shingles(text, k):
    w = text.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).split()
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def brute(rows, k, num, den):
    sets = [(i, shingles(t or "", k)) for i, t in rows]
    root = {i: i for i, _ in rows if i is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, (i, s) in enumerate(sets):
        for j, t in sets[:a]:
            if i is not None and j is not None and s and t and den * len(s & t) >= num * len(s | t):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return sorted((i if i is not None else -1, len(s), find(i) if i is not None else -1) for i, s in sets)


def edited(rng, base, edits):
    w = base.split()
    for _ in range(edits):
        p = rng.randrange(len(w))
        kind = rng.random()
        if kind < 0.6:
            w[p] = f"e{rng.randrange(6)}" if rng.random() < 0.4 else f"u{rng.randrange(10**6)}"
        elif kind < 0.8:
            del w[p]
        else:
            w.insert(p, f"i{rng.randrange(9)}")
    return " ".join(w)


@pytest.mark.parametrize("k,num,den,seed", [(4, 85, 100, 1), (5, 80, 100, 2)])
def test_random_near_copies(spark, k, num, den, seed):
    rng = random.Random(seed)
    rows = []
    for base in range(6):
        text = " ".join(f"w{rng.randrange(40 if base % 2 else 4000)}" for _ in range(rng.choice([8, 60, 150, 260])))
        for _ in range(60):
            rows.append((len(rows) * 3 % 1000, edited(rng, text, rng.choice([0, 0, 1, 1, 2, 3, 4, 6]))))
    rows += [(2000, None), (2001, ""), (2002, "one"), (2003, "ONE"), (2004, "a b c"), (None, rows[0][1]), (2005, "  \n"), rows[5]]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.n_shingles, r.component_id if r.doc_id is not None else -1) for r in ngram_join.join(df, k=k, num=num, den=den).distinct().collect())
    assert got == sorted(set(brute(rows, k, num, den)))


def degrees(rows, k, num, den):
    """(id, how many other rows with an id link with the row), by every pair."""
    sets = [(i, shingles(t or "", k)) for i, t in rows if i is not None]
    near = [sum(bool(s and u) and den * len(s & u) >= num * len(s | u) for b, (_, u) in enumerate(sets) if a != b) for a, (_, s) in enumerate(sets)]
    return [(i, n) for (i, _), n in zip(sets, near)]


@pytest.mark.parametrize("k,num,den,seed,again", [(4, 85, 100, 3, False), (5, 80, 100, 4, True)])
def test_links_are_counted_whole(spark, k, num, den, seed, again):
    rng = random.Random(seed)
    rows = []
    for base in range(6):
        text = " ".join(f"w{rng.randrange(40 if base % 2 else 4000)}" for _ in range(rng.choice([8, 60, 150, 260])))
        for _ in range(50):
            if rng.random() < 0.1:
                text = edited(rng, text, 2)
            rows.append((len(rows) * 7 % 1000, edited(rng, text, rng.choice([0, 0, 1, 1, 2, 3, 4, 6]))))
    rows += [(2000, None), (2001, ""), (2002, "one"), (2003, "ONE"), (2004, "a b c"), (None, rows[0][1])]
    rows += [rows[5], (rows[9][0], rows[60][1])] if again else []
    got = ngram_join.linked(spark.createDataFrame(rows, "doc_id long, text string"), k=k, num=num, den=den).collect()
    assert sorted((r.doc_id, r.n_links) for r in got if r.doc_id is not None) == sorted(degrees(rows, k, num, den))
    assert [r.n_links for r in got if r.doc_id is None] == [None]
    told = sorted({(r.doc_id if r.doc_id is not None else -1, r.n_shingles, r.component_id if r.doc_id is not None else -1) for r in got})
    assert told == sorted(set(brute(rows, k, num, den)))


def test_words_that_defeat_power_of_two_hashes(spark):
    one = "".join("ab"[bin(i).count("1") & 1] for i in range(1024))
    two = one.translate(str.maketrans("ab", "ba"))
    rows = [(1, one), (2, two), (3, f"x {one} y z"), (4, f"x {two} y z"), (5, f"x {one} y z")]
    got = sorted((r.doc_id, r.component_id) for r in ngram_join.join(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(1, 1), (2, 2), (3, 3), (4, 4), (5, 3)]


def test_sizes_at_the_edges_of_bands(spark):
    """Partners whose sizes are as far apart as the threshold allows, of groups of several sizes."""
    rng = random.Random(5)
    rows = []
    for _ in range(12):
        words = [f"w{rng.randrange(10**6)}" for _ in range(rng.randrange(24, 400))]
        for _ in range(8):
            n = len(words) - 3
            keep = rng.choice([n, -(-85 * n // 100), -(-85 * n // 100) - 1, -(-93 * n // 100)])
            at = rng.randrange(n - keep + 1)
            rows.append((len(rows), " ".join(words[at : at + keep + 3])))
    got = ngram_join.linked(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute(rows, 4, 85, 100)
    assert sorted((r.doc_id, r.n_links) for r in got) == degrees(rows, 4, 85, 100)


SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_links_equal_the_sql_s(spark):
    import duckdb

    import __spark_entry__ as entry

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    rel = con.sql(entry.oracle_sql()["op2_ngram_links"])
    got = entry.queries()["op2_ngram_links"](spark, SF)
    assert got.columns == rel.columns == ["doc_id", "n_shingles", "component_id", "n_links"]
    assert sorted(tuple(r) for r in got.collect()) == sorted(rel.fetchall())
