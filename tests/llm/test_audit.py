"""Token alignment, source divergence and web archives: brute force, SQL, round trips, odd tables."""

import hashlib
import io
import zlib
from collections import Counter, defaultdict
from itertools import pairwise

import numpy as np
import pytest
from cases import ROWS
from compare import DATA, same

from hostloom.llm import queries
from hostloom.llm import source_divergence as divergence
from hostloom.llm import token_alignment as alignment
from hostloom.llm import warc
from hostloom.llm.scratch import Scratch


@pytest.mark.parametrize("name", ["op12_source_divergence", "op13_warc"])
@pytest.mark.parametrize("sf", [DATA, "/root/testdata/sf0.01"])
def test_sql(spark, name, sf):
    same(queries.QUERIES[name](spark, sf), queries.SQL[name], sf)


# Alignment


def plain_alignment(rows, a="byte_bpe_50k.json", b="piece_bpe_32k.model"):
    """Token by token: every pair of tokens is compared."""
    own = alignment.Tokenizers(a, b)
    docs = []
    for doc, text in rows:
        ids_a, ids_b, raw = [], [], (" " + (text or "")).encode()
        if text:
            ids_a, ids_b = own.a.encode(" " + text, add_special_tokens=False).ids, own.b.encode(text)
        sides = []
        for ids, table in ((ids_a, own.a_bytes), (ids_b, own.b_bytes)):
            ends = np.cumsum([0] + [len(table[k]) for k in ids]).tolist()
            sides.append([(k, i, j) for k, (i, j) in zip(ids, pairwise(ends), strict=True)])
        if any(b"".join(t[k] for k, *_ in s) != raw for s, t in zip(sides, (own.a_bytes, own.b_bytes), strict=True)):
            sides = [[], []]
        cuts = sorted({e for *_, e in sides[0]} & {e for *_, e in sides[1]})
        groups, start = [], 0
        for end in cuts:
            groups.append("|".join(",".join(str(k) for k, i, j in s if start <= i and j <= end) for s in sides))
            start = end
        links, low = [], 0
        for k, i, j in sides[0]:
            while low < len(sides[1]) and sides[1][low][2] <= i:
                low += 1
            at = low
            while at < len(sides[1]) and sides[1][at][1] < j:
                links.append((k, sides[1][at][0]))
                at += 1
        docs.append((doc, len(sides[0]), len(sides[1]), len(groups), links, ";".join(groups)))
    counts = Counter(p for *_, links, _ in docs for p in set(links))
    best = defaultdict(int)
    for (a_id, _), n in counts.items():
        best[a_id] = max(best[a_id], n)
    return sorted(
        (str(d), a_n, b_n, g, len(links), sum(counts[p] == best[p[0]] for p in links), sum(counts[p] for p in links), hashlib.sha256(w.encode()).hexdigest() if w else "")
        for d, a_n, b_n, g, links, w in docs
    )


ODD = ["▁under ▁score", " lead", "tail  ", "a\n\n b\tc", "<s> </s> <|endoftext|> <unk> <0x41>", "\x00\x01", "͸ \U0001fae8 ǅ", "中文 日本語 한국어", "é é ﬁ", "xyz" * 300, " " * 3000 + "x", "don't WON'T 12345 3.14"]


def test_alignment_equals_token_by_token(spark):
    rows = [(r[0], r[1][:20_000] if r[1] else r[1]) for r in ROWS] + [(100 + k, t) for k, t in enumerate(ODD)]
    frame = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, n_a int").repartition(3)
    for hot in (1, 40, alignment.HOT):
        found = alignment.align_tokens(frame, hot=hot)
        assert found.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
        assert sorted((str(r[0]), *r[1:]) for r in found.collect()) == plain_alignment(rows)
    assert alignment.align_tokens(frame.filter("false")).isEmpty()


def test_alignment_of_documents(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    found = queries.QUERIES["op11_token_alignment"](spark, DATA).collect()
    assert sorted((str(r[0]), *r[1:]) for r in found) == plain_alignment(rows)


def test_both_libraries_agree_where_they_must(spark):
    own = alignment.tokenizers("byte_bpe_50k.json", "piece_bpe_32k.model", "byte_bpe_50k.tiktoken")
    rng = np.random.default_rng(5)
    settled = [chr(c) for c in range(1, 0x30000) if not 0xD800 <= c < 0xE000 and alignment._settled(chr(c))]
    texts = ["".join(rng.choice([*settled[: int(most)], " ", "\n", "a", "1", "'s"], 200)) for most in rng.choice([100, 600, 5000, len(settled)], 300)]
    assert all(map(alignment.plain, texts))
    assert [own.fast.encode_ordinary(t) for t in texts] == [e.ids for e in own.a.encode_batch(texts, add_special_tokens=False)]
    assert not alignment.plain("͸") and not alignment.plain("\U0001fae8") and not alignment.plain(" " * 1000)


def test_links_and_products(spark):
    texts = [(1, "antidisestablishmentarianism unbelievable"), (2, None), (3, "x")]
    frame = spark.createDataFrame(texts, "doc_id long, text string")
    own = alignment.Tokenizers("byte_bpe_50k.json", "piece_bpe_32k.model")
    links = alignment.token_links(frame).collect()
    x = alignment.Aligned(own, [texts[0][1]])
    assert [(r.a_pos, r.b_pos, r.start, r.end) for r in sorted(links) if r.doc_id == 1] == [(i, j, max(x.a_ends[i] - own.a_len[x.a[i]], x.b_ends[j] - own.b_len[x.b[j]]), min(x.a_ends[i], x.b_ends[j])) for i in range(len(x.a)) for j in range(len(x.b)) if x.a_ends[i] - own.a_len[x.a[i]] < x.b_ends[j] and x.b_ends[j] - own.b_len[x.b[j]] < x.a_ends[i]]
    products = {(r.a_pos, r.b_pos) for r in alignment.token_links(frame, products=True).collect() if r.doc_id == 1}
    assert products == {(i, j) for i in range(len(x.a)) for j in range(len(x.b)) if x.a_group[i] == x.b_group[j]}


# Divergence


def plain_divergence(rows, least=3, top=200):
    import re

    rows = [tuple(v or "" for v in r) for r in rows]
    words = [(lang, source, re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))) for lang, source, text in rows]
    out = []
    for lang in {r[0] for r in rows}:
        own = [(s, w) for x, s, w in words if x == lang]
        seen = Counter(t for _, w in own for t in set(w))
        kept = [t for t in seen if seen[t] >= least]
        groups = {s: Counter(t for x, w in own if x == s for t in w if seen[t] >= least) for s in {s for s, _ in own}}
        p = lambda c: {t: 1 + 1_000_000_000 * (c[t] + 1) // (sum(c.values()) + len(kept)) for t in kept}
        shares, whole = {s: p(c) for s, c in groups.items()}, p(sum(groups.values(), Counter()))
        f = lambda p, q: (p - q) ** 2 // q
        for s, mine in shares.items():
            pairs = [(sum(f(mine[t], q[t]) for t in kept), o) for o, q in shares.items() if o != s]
            terms = [(f(mine[t], whole[t]), t) for t in kept if groups[s][t] and mine[t] > whole[t]]
            for part, found, most in (("pair", pairs, len(pairs)), ("term", terms, top)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, v, k) for k, (v, item) in enumerate(found[:most], 1)]
    return sorted(out)


def test_divergence_equals_a_plain_loop(spark):
    rng = np.random.default_rng(3)
    vocabulary = ["Alpha", "beta", "GAMMA", "ÉTÉ", "été", "中文", "d1e2f", "x_y", "one-two", "", "ẞ", "\U0001f600a"]
    rows = [(str(rng.choice(["en", "de", ""])), f"s{rng.integers(0, 9)}", " ".join(rng.choice(vocabulary, 12))) for _ in range(120)]
    rows += [(None, None, None), ("xx", "only", "nothing kept"), ("yy", "a", "rare"), ("yy", "b", ""), ("yy", None, "other")] + rows[:5]
    frame = spark.createDataFrame([(*r, 1, "z") for r in rows], "lang string, source string, text string, n int, term string").repartition(4)
    for sizes in ({}, {"block": 2, "chunk": 3, "stripe": 2}, {"block": 1, "chunk": 1, "stripe": 1}):
        assert sorted(map(tuple, divergence.source_divergence(frame, **sizes).collect())) == plain_divergence(rows)
    assert sorted(map(tuple, divergence.source_divergence(frame, top=2, block=3, chunk=4).collect())) == plain_divergence(rows, top=2)
    assert divergence.source_divergence(frame.filter("false")).isEmpty()


def test_shares_are_exact(spark):
    rng = np.random.default_rng(1)
    counts = np.concatenate([rng.integers(0, 10**15, 200), [0, 1, 10**15]])
    for whole in (1, 7, 10**6 + 3, 9 * 10**14, 10**15 + 1):
        exact = [1 + 10**9 * (int(c) + 1) // whole for c in counts]
        if max(exact) < 1 << 62:
            assert divergence.shares(counts, whole).tolist() == exact
            frame = spark.createDataFrame([(int(c), whole) for c in counts], "c long, w long")
            from pyspark.sql import functions as F

            assert [r[0] for r in frame.select(divergence.share(F.col("c"), F.col("w"))).collect()] == exact


# Archives


def gz(*parts):
    out = []
    for p in parts:
        z = zlib.compressobj(6, zlib.DEFLATED, 31)
        out.append(z.compress(p) + z.flush())
    return b"".join(out)


HTTP = b"HTTP/1.0 200 OK\nContent-Type: text/html\n\n<p>one\r\n\r\ntwo</p>"
PAGE = HTTP[HTTP.index(b"<p>") :]
BODY = b"1 0 Origin\nURL IP-address Archive-date Content-type Archive-length\nmore\n"
V1 = [
    b"filedesc://old.arc 0.0.0.0 19970101120000 text/plain %d\n" % len(BODY) + BODY + b"\n",
    b"http://a.org/x 1.2.3.4 19970102030405 text/html; charset=latin 1 %d\n" % len(HTTP) + HTTP + b"\n",
    b"dns:a.org 1.1.1.1 199701020304 text/dns 5\nhello\n",
]
V2 = [
    b"filedesc://new.arc 0.0.0.0 20010101120000 text/plain 200 - - 0 new.arc 11\n2 0 Origin\n\n",
    b"http://b.org/a b 5.6.7.8 20010102030405 text/html 404 ABC - 120 new.arc %d\n" % len(HTTP) + HTTP + b"\n",
    b"ftp://b.org/f - 20010102030406 no-type - - - 300 new.arc 3\n\n\n\n\n",
]


def test_arc_versions():
    for parts, version, uris in ((V1, 1, ["http://a.org/x", "dns:a.org"]), (V2, 2, ["http://b.org/a b", "ftp://b.org/f"])):
        for data in (b"".join(parts), gz(*parts), gz(b"".join(parts))):
            found = list(warc.arc_records(io.BytesIO(data)))
            assert [r.version for r in found] == [version] * 3
            assert [r.fields["url"] for r in found[1:]] == uris
            assert found[1].block == HTTP
            at = 0
            for r, p in zip(found, parts, strict=True):
                assert b"".join(parts)[r.offset :].startswith(p[:40]) and r.offset == at
                at += len(p)
    assert found[1].fields["result"] == "404" and found[1].fields["checksum"] == "ABC" and found[2].block == b"\n\n\n"
    for bad in (gz(*V1)[:-9], b"".join(V1)[:-4], b"http://x 0.0.0.0 19970101120000 text/plain 0\n", V1[0].replace(b"\n1 0", b"\n9 0", 1), b"".join(V1[:1]) + b"no header\n"):
        with pytest.raises((EOFError, ValueError)):
            list(warc.arc_records(io.BytesIO(bad)))


def test_conversion_synthesises_equivalent_records():
    response, name = list(warc.arc_records(io.BytesIO(b"".join(V1)))), "/somewhere/old.arc.gz"
    data = gz(*(warc.converted(name, r) for r in response), warc.converted(name, response[1], ("<urn:x>", "http://z/", "1997-01-01T00:00:00Z")))
    (info, _), (page, block), (dns, text), (again, head) = warc.warc_records(io.BytesIO(data))
    assert info["warc-type"] == "warcinfo" and info["warc-filename"] == "old.arc.gz"
    assert (page["warc-type"], page["warc-date"], page["warc-target-uri"], page["warc-ip-address"]) == ("response", "1997-01-02T03:04:05Z", "http://a.org/x", "1.2.3.4")
    assert block == HTTP and page["warc-block-digest"] == warc.sha1_32(HTTP) and page["warc-payload-digest"] == warc.sha1_32(PAGE)
    assert page["content-type"] == "application/http; msgtype=response"
    assert (dns["warc-type"], dns["warc-date"], dns["content-type"], text) == ("resource", "1997-01-02T03:04:00Z", "text/dns", b"hello")
    assert again["warc-type"] == "revisit" and again["warc-refers-to"] == "<urn:x>" and again["warc-profile"] == warc.PROFILE
    assert head == HTTP.removesuffix(PAGE) and again["warc-payload-digest"] == page["warc-payload-digest"]
    ids = [r["warc-record-id"] for r in (info, page, dns)]
    assert len(set(ids)) == 3 and again["warc-record-id"] == ids[1] and all(i.startswith("<urn:uuid:") for i in ids)


def test_archives_keep_bytes_and_files_roll(spark, tmp_path, monkeypatch):
    out = warc.Files(f"file://{tmp_path}/w", ".warc.gz", warc.warc_info)
    monkeypatch.setattr(warc, "FILE_BYTES", 5000)
    blocks = [bytes([k]) * (k * 100) for k in range(20)]
    for k, b in enumerate(blocks):
        out.add(warc.warc_record([("WARC-Type", "resource"), ("WARC-Record-ID", f"<{k}>")], b))
    out.close()
    assert len(out.done) > 2
    found = []
    for name, *_ in out.done:
        with warc.opened(name) as raw:
            found += [(h["warc-record-id"], b) for h, b in warc.warc_records(raw) if h["warc-type"] != "warcinfo"]
    assert found == [(f"<{k}>", b) for k, b in enumerate(blocks)]


def test_odd_pages(spark):
    long, other = "x" * 1000, "é" * 500
    rows = [(1, "http://a/", long), (5, None, long), (None, "u v\nw", long), (3, "http://a/", None), (4, "", ""), (6, "http://b/", other), (6, "http://b/", other), (7, "http://c/", "é" * 499), (8, "http://c/", "é" * 499), (9, "ftp://d/", long[:999] + "\r\n\r\n"), (-2, "http://e/", "HTTP/1.1 200 OK\r\n\r\nX-Page-Id: 77\r\n" + "z" * 3_000_000)]
    frame = spark.createDataFrame([(*r, "x", 2) for r in rows], "page_id long, url string, html string, path string, offset int").repartition(3)
    found = sorted(map(repr, (tuple(r) for r in warc.archived(frame).collect())))

    def row(page, body, of=None):
        data = (body or "").encode()
        return page, len(data), hashlib.sha1(data).hexdigest(), "revisit" if of else "response", of

    expected = [row(*r[::2]) for r in rows]
    expected[0], expected[2] = row(1, long, 5), row(None, long, 5)
    expected[5] = row(6, other, 6)
    assert found == sorted(map(repr, expected))
    assert warc.archived(frame.filter("false")).isEmpty()


def test_reads_archives_of_others(spark, tmp_path):
    (tmp_path / "old.arc.gz").write_bytes(gz(*V1))
    (tmp_path / "new.arc").write_bytes(b"".join(V2))
    scratch = Scratch(spark)
    files = spark.createDataFrame([(f"file://{tmp_path}/{n}",) for n in ("old.arc.gz", "new.arc")], "path string")
    out = scratch.cut(warc.arc_to_warc(files, f"{scratch.path}/warc", scratch, least=1))
    found = sorted((r.uri, r.type, r.date, r.payload_bytes) for r in warc.read_warc(out).collect())
    assert found == [("dns:a.org", "resource", "1997-01-02T03:04:00Z", 5), ("ftp://b.org/f", "resource", "2001-01-02T03:04:06Z", 3), ("http://a.org/x", "response", "1997-01-02T03:04:05Z", len(PAGE)), ("http://b.org/a b", "revisit", "2001-01-02T03:04:05Z", None)] or found[2][1] == "revisit"
    (tmp_path / "bad.arc").write_bytes(b"".join(V1)[:-4])
    with pytest.raises(Exception, match="bad.arc"):
        warc.arc_index(spark.createDataFrame([(f"file://{tmp_path}/bad.arc",)], "path string")).collect()
