"""Language ID, toxicity, tokens, decontamination and LM scoring against brute force, the library or held-out rows."""

import collections
import hashlib
import math
import struct
import zlib

import numpy as np
import pytest
from compare import DATA
from hypothesis import example, given, settings
from hypothesis import strategies as st
from cases import ROWS, words

from hostloom.llm import bpe, decontaminate, language_id, lm_score, token_counts, toxicity
from hostloom.llm.scratch import Scratch

LARGER = DATA.replace("sf0.001", "sf0.01")


def table(spark, name, sf=DATA):
    return spark.read.parquet(f"{sf}/{name}.parquet")


# Language ID


def test_language_held_out_accuracy(spark):
    got = language_id.op2_language_id(spark, LARGER).filter("held_out").join(table(spark, "documents", LARGER).select("doc_id", "lang"), "doc_id").collect()
    assert len(got) > 150
    assert sum(r.lang == r.lang_pred for r in got) / len(got) > 0.98


def plain_ppm(samples, text):
    """Bits of text by prediction by partial matching with dictionaries: method C, exclusions, frozen counts."""
    pad, order = b"\n" * language_id.ORDER, language_id.ORDER
    seen = collections.Counter((pad + t)[i - k : i] for texts in samples.values() for t in texts for i in range(order, order + len(t)) for k in range(order + 1))
    out = []
    for language in sorted(samples):
        after = collections.defaultdict(collections.Counter)
        for t in samples[language]:
            for i in range(order, order + len(t)):
                for k in range(order + 1):
                    after[(pad + t)[i - k : i]][(pad + t)[i]] += 1

        def chances(context):
            below = chances(context[1:]) if context else [1 / 256] * 256
            if not after[context] or (context and seen[context] < language_id.LEAST):
                return below
            n, kinds = sum(after[context].values()), len(after[context])
            left = sum(p for s, p in enumerate(below) if s not in after[context])
            return [after[context][s] / (n + kinds) if s in after[context] else kinds / (n + kinds) * p / left for s, p in enumerate(below)]

        whole = pad + text
        out.append(sum(-math.log2(chances(whole[i - order : i])[whole[i]]) for i in range(order, len(whole))))
    return out


@pytest.mark.parametrize("piece", [1 << 18, 7])
def test_code_lengths_are_those_of_the_plain_method(monkeypatch, piece):
    monkeypatch.setattr(language_id, "PIECE", piece)
    samples = {"a": [b"the cat sat on the mat, the cat", b"that", b""], "b": ["là, où l'été naît\n\nun chat là".encode(), b"le chat"], "c": [b""]}
    model = language_id.fit(samples)
    texts = [b"the chat", b"", "où est l'été".encode(), bytes(range(256)), b"the cat sat on the hat"]
    cuts = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    got = language_id.code_lengths(model, np.frombuffer(b"".join(texts), np.uint8), cuts)
    assert np.allclose(got, [plain_ppm(samples, t) for t in texts], rtol=1e-4, atol=1e-4)


def test_trees_are_bounded(monkeypatch):
    monkeypatch.setattr(language_id, "CELLS", 40)
    rng = np.random.default_rng(1)
    model = language_id.fit({"a": [rng.integers(97, 123, 5000, np.uint8).tobytes()], "b": [b"abab " * 50]})
    assert all(len(level.escape) <= 20 for level in model.levels)
    p = np.exp2(-np.array([language_id.code_lengths(model, np.frombuffer(b"abab" + bytes([s]), np.uint8), np.array([0, 5]))[0] for s in range(256)]))
    base = np.exp2(-language_id.code_lengths(model, np.frombuffer(b"abab", np.uint8), np.array([0, 4]))[0])
    assert np.allclose(p.sum(0) / base, 1, atol=1e-3)


def test_language_cases(spark, docs, empty):
    model = language_id.train(table(spark, "documents"))
    got = language_id.detect_language(docs, model, keep=docs.columns)
    rows = got.collect()
    assert len(rows) == len(ROWS) and {f"kept_{c}" for c in docs.columns} <= set(got.columns)
    for r in rows:
        assert (r.lang_pred == "und") == (r.kept_text is None or not any(c.isalpha() for c in r.kept_text))
        assert 0 <= r.score <= 1
    assert language_id.detect_language(empty, model).count() == 0
    nothing = language_id.train(empty)
    assert {r.lang_pred for r in language_id.detect_language(docs, nothing).collect()} == {"und"}


# BPE


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bpe.vocabulary_path("word_bpe_49k.json"))
    t.no_truncation()
    t.no_padding()
    return t


def by_library(t, text):
    ids = t.encode(text or "", add_special_tokens=False).ids
    return b"".join(struct.pack("<I", i) for i in ids), t.decode(ids, skip_special_tokens=False)


@settings(max_examples=300, deadline=None)
@example(":\U0003d000 x\U000b0000y")
@given(st.text(max_size=60) | st.text("abcdeinorst'ésß \n.,!?1#ΣİǅḰ", max_size=60))
def test_bpe_is_that_of_the_library(text):
    from tokenizers import Tokenizer

    path = bpe.vocabulary_path("word_bpe_49k.json")
    t = test_bpe_is_that_of_the_library.__dict__.setdefault("library", Tokenizer.from_file(path))
    assert list(bpe.encoder(path).encode([text])) == [by_library(t, text)]


def test_bpe_query(spark, library):
    got = {r.doc_id: r for r in bpe.op5_bpe(spark, DATA).collect()}
    for d in table(spark, "documents").collect():
        raw, text = by_library(library, d.text)
        r = got[d.doc_id]
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(raw) // 4, hashlib.sha256(raw).hexdigest(), hashlib.sha256(text.encode()).hexdigest())


def test_bpe_cases(docs, empty, library):
    rows = bpe.bpe_encode(docs, keep=["doc_id", "text", "n"]).collect()
    assert len(rows) == len(ROWS)
    assert all((bytes(r.ids), r.decoded) == by_library(library, r.text) for r in rows)
    path = bpe.vocabulary_path("word_bpe_49k.json")
    assert all(bpe.decode(np.frombuffer(r.ids, "<u4").tolist(), path) == r.decoded for r in rows)
    assert bpe.bpe_encode(empty, keep=[]).count() == 0
    clash = bpe.bpe_encode(docs.withColumnRenamed("n", "Ids").withColumnRenamed("id", "_ids"), keep=["doc_id", "Ids", "_ids"], decoded=False)
    assert clash.columns == ["n_tokens", "ids", "doc_id", "__Ids", "_ids"] and {r["__Ids"] for r in clash.collect()} == {1.5}


def test_long_words_take_linear_time(library):
    import time

    own, took = bpe.Encoder(bpe.vocabulary_path("word_bpe_49k.json")), []
    for n in (40_000, 160_000):
        word, began = "abcd" * (n // 4), time.perf_counter()
        assert next(iter(own.encode([word]))) == by_library(library, word)[:2]
        took.append(time.perf_counter() - began)
    assert took[1] < 12 * took[0] + 1


# Token counts


@pytest.mark.parametrize("run", [2, 1 << 12])
def test_separator_scan(spark, monkeypatch, run):
    import random

    monkeypatch.setattr(token_counts, "RUN", run)
    r, rows, want = random.Random(run), [], set()
    for f, size in enumerate([0, 1, 7, 50, 333]):
        tokens = [r.choice([1, 2, 9]) if f % 2 else r.choice([1, 2, 3, 4, 5, 6, 7, 8, 9]) for _ in range(size)]
        rows += [(f"f{f}", k // 7, bytearray(np.array(tokens[k : k + 7], "<u2").tobytes()), "x") for k in range(0, size, 7)]
        n = ordinal = 0
        for t in tokens:
            if t == 9:
                want.add((f"f{f}", ordinal, n, True))
                n, ordinal = 0, ordinal + 1
            else:
                n += 1
        if n:
            want.add((f"f{f}", ordinal, n, False))
    blocks = spark.createDataFrame(rows, "file string, block long, payload binary, run string")
    got = [tuple(x) for x in token_counts.token_counts(blocks, separator=9).collect()]
    assert len(got) == len(want) and set(got) == want
    assert token_counts.token_counts(blocks.filter("false"), separator=9).count() == 0


def test_token_files(spark, tmp_path):
    np.array([1, 2, 9, 9, 3], "<u2").tofile(tmp_path / "a.bin")
    np.array([9], "<u2").tofile(tmp_path / "b.bin")
    got = token_counts.token_counts(token_counts.read_token_files(spark, str(tmp_path)), separator=9).collect()
    assert sorted((r.file[-5:], r.ordinal, r.n_tokens, r.ended) for r in got) == [("a.bin", 0, 2, True), ("a.bin", 1, 0, True), ("a.bin", 2, 1, False), ("b.bin", 0, 0, True)]


def test_large_token_files_are_cut_into_ranges(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(token_counts, "BLOCK", 64)
    r = np.random.default_rng(2)
    tokens = np.where(r.random(64 * 50 + 17) < 0.01, 9, r.integers(10, 60_000, 64 * 50 + 17)).astype("<u2")
    tokens.tofile(tmp_path / "large.bin")
    (tmp_path / "empty.bin").write_bytes(b"")
    blocks = token_counts.read_token_files(spark, str(tmp_path), blocks_a_read=8).collect()
    assert [x.block for x in sorted(blocks, key=lambda x: x.block)] == list(range(51))
    assert b"".join(bytes(x.payload) for x in sorted(blocks, key=lambda x: x.block)) == tokens.tobytes()
    whole = [bytes(x.column(2)[0].as_py()) for x in token_counts._whole(128)(iter([__import__("pyarrow").RecordBatch.from_pydict({"path": ["f"], "content": [tokens.tobytes()]})]))]
    assert b"".join(whole) == tokens.tobytes() and len(whole) == 51


def test_token_count_query(spark, docs, library):
    library.encode_special_tokens = True
    blocks, names = token_counts.flatten(docs, Scratch(spark))
    got = token_counts.token_counts(blocks).join(names, ["file", "ordinal"]).collect()
    want = sorted((i or 0, len(library.encode(t or "", add_special_tokens=False).ids)) for i, t, _ in ROWS)
    library.encode_special_tokens = False
    assert sorted((r.doc_id or 0, r.n_tokens) for r in got) == want


# Decontamination


def test_decontamination_query(spark):
    from compare import same

    same(decontaminate.op9_decontamination(spark, LARGER), decontaminate.OP9_SQL, LARGER)


def test_decontamination_cases(spark, docs, empty):
    items = spark.createDataFrame([(1, "fox jumps over the LAZY dog near the old river bank", 1), (2, None, 1), (3, "too short", 1), (4, "word " * 9, 1)], "item_id long, text string, doc_id int")
    got = decontaminate.contamination(docs, items)
    assert sorted((r.doc_id or 0, r.item_id) for r in got.collect()) == [(0, 1), (1, 1), (2, 1), (7, 1), (9, 4)]  # "too short" is in none
    left = decontaminate.without_contamination(docs, items)
    assert left.columns == docs.columns
    assert sorted(r.doc_id for r in left.collect()) == [3, 4, 5, 6, 8, 10, 10, 11]
    assert decontaminate.contamination(empty, items).count() == 0
    assert decontaminate.contamination(docs, items.filter("false")).count() == 0


def test_items_of_all_sizes_are_found(spark):
    import random

    r = random.Random(3)
    text = lambda n: [f"v{r.randrange(100_000)}" for _ in range(n)]
    items = [(k, text(n)) for k, n in enumerate([5, 6, 9, 13, 20, 33, 40, 64, 65, 100, 250] * 8)]
    rows = [(k, " ".join([*text(r.randrange(3000)), *w, *text(r.randrange(3000))])) for k, w in items]
    got = decontaminate.contamination(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(k, " ".join(w)) for k, w in items], "item_id long, text string")).collect()
    assert {(x.doc_id, x.item_id) for x in got} == {(k, k) for k, _ in items}


def test_items_of_few_words_are_found_whole(spark):
    items = [(1, "Red  FISH"), (2, "red fish"), (3, "fish"), (4, "one two three four"), (5, ""), (6, "fish red"), (7, "a b c d e"), (8, "x " * 40_000)]
    rows = [(1, "the red\tfish swims"), (2, "red"), (3, "redfish"), (4, "One two three four"), (5, None), (6, "x " * 40_000), (7, "a b c d e f"), (1, "the red\tfish swims")]
    docs, table_ = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = sorted((r.doc_id, r.item_id, r.n_item, r.n_shared) for r in decontaminate.contamination(docs, table_).collect())
    assert got == [(1, 1, 1, 1), (1, 1, 1, 1), (1, 2, 1, 1), (1, 2, 1, 1), (1, 3, 1, 1), (1, 3, 1, 1), (4, 4, 1, 1), (6, 8, 1, 1), (7, 7, 1, 1)]
    assert sorted(r.doc_id for r in decontaminate.without_contamination(docs, table_, short=False).collect()) == [1, 1, 2, 3, 4, 5]


# Toxicity


def plain_kernel(a, b):
    """Common subsequences of three characters, by all pairs of places: the kernel without any feature map."""
    def parts(w):
        w, out = f"^{w}$", collections.Counter()
        for i in range(len(w)):
            for j in range(i + 1, len(w)):
                for k in range(j + 1, min(len(w), i + toxicity.SPAN)):
                    out[w[i] + w[j] + w[k]] += toxicity.DECAY ** (k - i + 1)
        return out

    x, y = parts(a), parts(b)
    dot = lambda p, q: sum(v * q[c] for c, v in p.items())
    return dot(x, y) / math.sqrt(dot(x, x) * dot(y, y))


def test_kernel_is_that_of_all_common_subsequences():
    some = ["idiot", "idxiot", "i", "moron", "iidioott", "stupid", "dot"]
    found = toxicity.feature_map(some) @ toxicity.feature_map(some).T
    for i, a in enumerate(some):
        for j, b in enumerate(some):
            assert abs(found[i, j] - plain_kernel(a, b)) < 0.02


def test_toxicity_held_out(spark):
    got = toxicity.op7_toxicity(spark, DATA.replace("sf0.001", "sf0.1")).filter("held_out").join(table(spark, "labels", DATA.replace("sf0.001", "sf0.1")), "doc_id").collect()
    hit = [r for r in got if r.toxic == 1 and r.predicted == 1]
    assert len(hit) / sum(r.toxic == 1 for r in got) > 0.85
    assert len(hit) / sum(r.predicted == 1 for r in got) > 0.75


def test_long_words_teach_and_are_scored_in_all_windows():
    rows = toxicity.feature_map(["a" * 60, "idiot"])
    assert len(rows) == len(toxicity._codes(["a" * 60])[0]) + 1 > 4
    start = "abcdefghijklmnopqrstuvwxyz"  # longer than a window: only later ones tell the words apart
    bad, good = [f"{start}dreckskerl here"], [f"{start}blumentopf here", "a river"]
    y = np.array([1] * 40 + [0] * 80)
    s = toxicity.Scorer(toxicity.fit(bad * 40 + good * 40, y, np.ones(len(y))))([*bad, *good])
    assert s[0] > 0.5 > s[1:].max()


def test_several_words_say_more_than_one():
    """The calibration is a plain logistic regression of the labels on the three highest decisions."""
    rng = np.random.default_rng(4)
    x = np.sort(rng.normal(0, 2, (400, 3)))[:, ::-1]
    y = (x.sum(1) + rng.normal(0, 1, 400) > 3).astype(int)
    w = toxicity.calibrated(x, y, np.ones(400))
    loss = lambda v: -np.log(1 / (1 + np.exp(-np.where(y == 1, 1, -1) * (x @ v[:-1] + v[-1])))).sum() + 5e-4 * (v[:-1] ** 2).sum()
    assert all(loss(w) <= loss(w + d) + 1e-9 for d in rng.normal(0, 0.01, (200, 4)))
    model = toxicity.Model(np.zeros(1, np.float32), 0.0, np.array([1.0, 1.0, 1.0, -4.0]), np.array([2.0, -5.0]))
    p = toxicity.probability(model, toxicity.worst([[2.0, 1.9, 1.8], [2.0], [3.0], []]))
    assert p[0] > 0.8 and p[1] < 0.5 < p[2] and p[3] < 0.01


def test_toxicity_tolerates_gaps_and_insertions():
    bad, good = ["you are an idiot today", "what a stupid moron"], ["a nice river bank", "the old dog sleeps here", "quick brown foxes jump"]
    texts = bad * 40 + good * 60
    y = np.array([1] * 80 + [0] * 180)
    model = toxicity.fit(texts, y, np.ones(len(y)))
    s = toxicity.Scorer(model)(["an i-d-i-o-t", "an idiiot", "an idxiot", "i d i o t", "the stuxpid one", "a nice river", ""])
    assert s[:5].min() > s[5:].max()


def test_toxicity_cases(spark, docs, empty):
    labels = table(spark, "labels")
    model = toxicity.train(table(spark, "documents"), labels)
    rows = toxicity.toxicity(docs, model).collect()
    assert len(rows) == len(ROWS) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    assert toxicity.toxicity(empty, model).count() == 0
    assert toxicity.train(table(spark, "documents"), labels.filter("toxic = 0")) is None
    assert {r.score for r in toxicity.toxicity(docs, None).collect()} == {0.0}


# LM scoring


def test_items_of_five_words_are_found():
    rng = np.random.default_rng(4)
    word = lambda n: [f"w{k}" for k in rng.integers(0, 10**9, n)]
    texts = [word(5) for _ in range(2000)]
    items = decontaminate.prepare(list(range(2000)), [" ".join(t) for t in texts], 5)
    parts = [decontaminate.shingle_hashes(w, 5) for _, w in decontaminate._words(list(range(2000)), [" ".join([*word(20), *t, *word(20)]) for t in texts])]
    cuts = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
    found = decontaminate.candidates(np.concatenate(parts), cuts, items)
    assert np.isin(np.arange(2000) * 2001, found).all()


def test_language_model_query(spark):
    rows = lm_score.op10_lm_score(spark, LARGER).collect()
    docs = {r.doc_id: r.text for r in table(spark, "documents", LARGER).collect()}
    count = collections.Counter()
    for i, t in docs.items():
        if zlib.crc32(str(i).encode()) % 7 != 2:
            count.update([*words(t), None])
    total, kinds = sum(count.values()), len(count)
    for r in rows:
        tokens = [*words(docs[r.doc_id]), None]
        base = sum(math.log10((count[w] + 1) / (total + kinds + 1)) for w in tokens)
        assert math.isclose(base, r.base_score, rel_tol=1e-9)
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(tokens), sum(count[w] > 0 for w in tokens), total)
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 7 == 2) and r.score < 0
    held = [r for r in rows if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_language_model_is_a_distribution(spark):
    rows = [(k, ["a b c a b c", "b c a", "x y"][k % 3]) for k in range(30)]
    scratch = Scratch(spark)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model, counts = lm_score.train(docs, scratch)
    one = lambda texts: [r.score for r in lm_score.score(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model, counts, scratch).orderBy("doc_id").collect()]
    known = one(["", "a", "b", "c", "x", "y"])  # first token: each word or the end; the rest of the mass is for unknown words
    ends = one(["a a", "b a"])
    assert 0 < sum(10**s for s in known) < 1 and all(s < 0 for s in ends)


def test_language_model_weights_grow_with_the_corpus(spark, monkeypatch):
    for name, value in (("ROWS", 4), ("WORDS_A_ROW", 8), ("BIGRAMS_A_ROW", 16)):
        monkeypatch.setattr(lm_score, name, value, raising=False)
    for n, rows in ((40, (8, 4)), (4000, (512, 256))):  # and the end: n + 1 words, n + 1 bigrams
        docs = spark.createDataFrame([(k, " ".join(f"w{j}" for j in range(k, n, 4))) for k in range(4)], "doc_id long, text string")
        model, _ = lm_score.train(docs, Scratch(spark))
        assert model.sizes == rows and len(model.weights) == 2 * rows[0] + rows[1] + 1
        assert np.count_nonzero(model.weights.any(1)) > len(model.weights) / 2


def test_language_model_counts_distinct_bigrams():
    registers = np.zeros(lm_score.REGISTERS, np.int64)
    for n in (100, 20_000, 1_000_000):
        for _ in range(2):
            lm_score._register(registers, lm_score.mix(np.arange(n, dtype=np.uint64)))
        assert abs(lm_score.distinct_of(registers) / n - 1) < 0.05
    assert lm_score.table_sizes(0, 0) == (1 << 14, 1 << 14) and lm_score.table_sizes(1 << 27, 1 << 32) == (1 << 20, 1 << 20)


def test_language_model_rare_words_by_join(spark, monkeypatch, docs, empty):
    whole = {}
    for head in (1 << 20, 0):
        monkeypatch.setattr(lm_score, "HEAD", head)
        scratch = Scratch(spark)
        model, counts = lm_score.train(docs, scratch)
        assert len(model.head) == 0 if head == 0 else len(model.head) > 0
        whole[head] = sorted((r.doc_id or 0, r.n_known, round(r.base_score, 6), round(r.score, 4)) for r in lm_score.score(docs, model, counts, scratch).collect())
    assert [x[:3] for x in whole[0]] == [x[:3] for x in whole[1 << 20]]
    assert len(whole[0]) == len(ROWS)
    model, counts = lm_score.train(empty, scratch)
    assert lm_score.score(empty, model, counts, scratch).count() == 0
    assert {r.n_known for r in lm_score.score(docs, model, counts, scratch).collect()} == {0}
