"""Exact and near dedup against brute force, with nulls, empty and long texts, repeats and clashing columns."""

import hashlib
import random

import numpy as np
from compare import DATA
from cases import ROWS, SPACE, words

from hostloom.llm.components import components
from hostloom.llm.exact_dedup import OP3_SQL, exact_dedup, op3_exact_dedup
from hostloom.llm.minhash_dedup import near_dedup
from hostloom.llm.scratch import Scratch


def texts(seed=5, n=150):
    """Groups of copies with edits, passages that many share, and one large group."""
    r = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(400)]
    line = [r.choice(vocabulary) for _ in range(30)]
    out = []
    for k in range(n):
        base = [r.choice(vocabulary) for _ in range(r.choice([2, 5, 40, 120]))] + (line if k % 3 == 0 else [])
        for _ in range(40 if k == 0 else r.choice([1, 1, 2, 3])):
            copy = list(base)
            for _ in range(r.choice([0, 0, 1, 2])):
                copy[r.randrange(len(copy))] = r.choice(vocabulary)
            out.append(" ".join(copy))
    r.shuffle(out)
    return out


def shingles(text, size):
    w = words(text)
    return {tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))} if w else set()


def linked(rows, size, percent):
    """Smallest reachable id of each row, all pairs compared."""
    sets = [(i, shingles(t, size)) for i, t in rows]
    root = {i: i for i, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            (i, x), (j, y) = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                p, q = sorted((find(i), find(j)))
                root[q] = p
    return {i: find(i) for i, _ in sets}


def test_near_dedup_is_that_of_all_pairs(spark):
    for size, percent in ((3, 85), (5, 80)):
        rows = list(enumerate(texts()))
        want = linked(rows, size, percent)
        got = near_dedup(spark.createDataFrame(rows, "doc_id long, text string"), size=size, percent=percent).collect()
        assert {r.doc_id: r.component_id for r in got} == want
        assert all(r.kept == (r.doc_id == r.component_id) for r in got)
        assert {r.doc_id: r.n_shingles for r in got} == {i: len(shingles(t, size)) for i, t in rows}


def test_large_nodes_branch_and_are_tiled(spark, monkeypatch):
    from hostloom.llm import minhash_dedup as M

    monkeypatch.setattr(M, "NODE", 8)
    monkeypatch.setattr(M, "TILE", 8)
    monkeypatch.setattr(M, "DEEPER", 2)
    rows = list(enumerate(texts(7)))
    got = near_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in got} == linked(rows, 3, 85)


def test_large_clusters_are_confirmed_part_by_part(spark, monkeypatch):
    """Clusters of many tiles: one that hangs together at once, one that only chains do, and one of candidates that aren't links."""
    from hostloom.llm import minhash_dedup as M

    monkeypatch.setattr(M, "TILE", 4)
    r = random.Random(11)
    near = [f"n{k}" for k in range(200)]
    rows = [" ".join(near[:i] + ["x", str(i)] + near[i:]) for i in range(0, 120, 4)]
    chain = [f"c{k}" for k in range(300)]
    rows += [" ".join(chain[k * 6 : k * 6 + 150]) for k in range(20)]
    rows += [" ".join([w if r.random() > 0.03 else f"d{k}-{i}" for i, w in enumerate(f"b{k}" for k in range(150))]) for k in range(40)]
    r.shuffle(rows)
    rows = list(enumerate(rows))
    got = near_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    want = linked(rows, 3, 85)
    assert {r.doc_id: r.component_id for r in got} == want
    assert len(set(want.values())) > 10


def test_common_counts_the_last_column_too():
    from hostloom.llm.minhash_dedup import _common

    for n in (1, 4095, 4096, 4097, 8193):
        both = np.arange(n, dtype=np.uint64)
        sets = [both, np.append(both, np.uint64(10**6)), np.array([n - 1, 10**7], np.uint64)]
        assert _common(sets)[0, 1] == n and _common(sets)[1, 2] == 1


def test_near_dedup_cases(docs, empty):
    got = sorted((r.doc_id or 0, r.component_id, r.n_shingles, r.kept) for r in near_dedup(docs).collect())
    assert len(got) == len(ROWS)
    by = {g[0]: g[1:] for g in got}
    assert by[1][0] == by[2][0] == by[7][0] == 1 and by[6][0] == by[11][0] == 6
    assert by[3] == (3, 0, True) and by[4] == (4, 0, True) and by[5] == (5, 0, True)
    assert by[0][0] is None and by[0][2] is True
    assert by[9][1] == 1 and by[10][0] == 10
    assert near_dedup(empty).count() == 0


def test_exact_dedup_is_that_of_the_texts(docs, empty):
    got = exact_dedup(docs).collect()
    assert len(got) == len(ROWS)
    plain = lambda t: SPACE.sub(" ", t or "")
    groups = {}
    for i, t, _ in ROWS:
        groups.setdefault(plain(t), []).append(i)
    for r in got:
        t = next(t for i, t, _ in ROWS if i == r.doc_id)
        same = groups[plain(t)]
        assert r.keep_id == min(i for i in same if i is not None)
        assert r.group_size == len(same) and r.kept == (r.doc_id == r.keep_id)
        assert r.text_sha256 == hashlib.sha256(plain(t).encode()).hexdigest()
    assert exact_dedup(empty).count() == 0


def test_long_texts_that_differ_late(spark):
    long = "x" * 5000
    rows = [(1, long + "a"), (2, long + "b"), (3, long + "a"), (4, long), (5, long + "b" * 40_000), (6, long + "b" * 39_999 + "c"), (7, long + "b" * 40_000)]
    got = {r.doc_id: r.keep_id for r in exact_dedup(spark.createDataFrame(rows, "doc_id long, text string"), width=2, growth=3).collect()}
    assert got == {1: 1, 2: 2, 3: 1, 4: 4, 5: 5, 6: 6, 7: 5}


def test_exact_dedup_query(spark):
    from compare import same

    same(op3_exact_dedup(spark, DATA), OP3_SQL, DATA)


def test_components(spark):
    edges = [(k, k + 1) for k in range(100, 130)] + [(1, k) for k in range(50, 80)] + [(5, 5)]
    got = {r.id: r.label for r in components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark)).collect()}
    assert got == {**dict.fromkeys(range(100, 131), 100), **dict.fromkeys([1, *range(50, 80)], 1)}


def test_words_of_any_structure_have_hashes_of_their_own(spark):
    """Thue-Morse words and their complements meet in any polynomial modulo a power of two."""
    import pyarrow as pa

    from hostloom.llm.shingles import text_words

    word = "a"
    while len(word) < 4096:
        word += word.translate(str.maketrans("ab", "ba"))
    found = {}
    for n in (1024, 2048, 4096):
        found[n], found[-n] = word[:n], word[:n].translate(str.maketrans("ab", "ba"))
    texts = [*found.values(), "x" * 64, "x" * 65, "x" * 128, "x" * 129, "ab" * 40, "ba" * 40]
    hashes = [int(h) for _, _, words_, _ in text_words(pa.array(texts)) for h in words_]
    assert len(set(hashes)) == len(texts)
    assert hashes == [int(h) for t in texts for _, _, words_, _ in text_words(pa.array([t])) for h in words_]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert all(r.kept for r in near_dedup(rows).collect())


def test_sieve_lets_all_of_the_ids_through(spark):
    from hostloom.llm import sieve

    rows = spark.range(20_000).selectExpr("id * 977 - 5 as id", "id as v").unionByName(spark.createDataFrame([(None, -1)], "id long, v long"))
    ids = rows.filter("v % 7 = 0").select("id")
    got = sieve.sifted(rows, ids, "id")
    assert got.columns == rows.columns
    kept = {r.id for r in got.collect()}
    assert {r.id for r in ids.collect()} <= kept and len(kept) < 4000 and None not in kept
    assert {r.v for r in sieve.without(rows, ids, "id").collect()} == {-1} | {v for v in range(20_000) if v % 7}
    assert sieve.without(rows, ids.filter("false"), "id").count() == 20_001 and sieve.sifted(rows, ids.filter("false"), "id").count() == 0


def test_recall_on_documents(spark):
    """All pairs of the documents compared, at the thresholds of the query and of the pipeline."""
    docs = spark.read.parquet(DATA.replace("sf0.001", "sf0.01") + "/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    for size, percent in ((3, 85), (5, 80)):
        got = {r.doc_id: r.component_id for r in near_dedup(docs, size=size, percent=percent).collect()}
        assert got == linked(rows, size, percent)
