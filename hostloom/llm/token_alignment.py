"""Cross-tokenizer alignment by elementary intervals.

Two tokenizers cut the same bytes in two ways. The union of both arrays of token ends cuts them into elementary
intervals; a binary search in each array names the token that owns an interval, so every interval is one overlap of an A
token with a B token, and every overlapping pair has exactly one interval. Ends that both arrays have close groups: runs
of A tokens and B tokens over the same bytes. The texts of a piece of a batch are laid end to end, so that one union and
two searches serve all of them.
"""

from __future__ import annotations

import hashlib
import os
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import byte_characters, vocabulary_path
from .scratch import Scratch, narrow_batches, tidy
from .shingles import chunks, text_buffers

#: Bytes of text that are aligned at once (a longer text is a piece of its own), and pairs that a task counts before it lets go.
PIECE, COUNTED = 1 << 20, 1 << 20
#: Pairs whose counts go to every task; the others meet their counts in a join.
HOT = 1 << 18
ALIGNED = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"


class Tokenizers:
    """A byte-level BPE file, with the same ranks for the faster library beside it, and a piece model."""

    def __init__(self, a: str, b: str, ranks: str | None = None):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(vocabulary_path(a))
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=vocabulary_path(b))
        byte_of = {c: k for k, c in enumerate(byte_characters())}
        self.a_bytes = [b""] * self.a.get_vocab_size()
        for token, k in self.a.get_vocab().items():
            self.a_bytes[k] = bytes(byte_of[c] for c in token) if all(c in byte_of for c in token) else token.encode()
        size = self.b.get_piece_size()
        pieces = [self.b.id_to_piece(k) for k in range(size)]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(k) else p.replace("▁", " ").encode() for k, p in enumerate(pieces)]
        self.a_len, self.b_len = (np.array([len(x) for x in t], np.int64) for t in (self.a_bytes, self.b_bytes))
        self.fast = self._ranked(ranks) if ranks else None
        #: Decimal numbers, each followed by nothing, a comma, a bar or a semicolon.
        self.most = max(len(self.a_bytes), size)
        self.decimal = [f"{k}{end}" for end in ("", ",", "|", ";") for k in range(self.most)]

    def _ranked(self, name: str):
        import base64

        import public_tokenizers
        import tiktoken

        with open(vocabulary_path(name), "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        return tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode_a(self, texts: list[str]) -> list[list[int]]:
        """Ids by the vocabulary file; texts on which both libraries must agree go to the faster one."""
        slow = [k for k, t in enumerate(texts) if self.fast is None or not plain(t)]
        out = dict(zip(slow, (e.ids for e in self.a.encode_batch_fast([texts[k] for k in slow], add_special_tokens=False)), strict=True)) if slow else {}
        return [out[k] if k in out else self.fast.encode_ordinary(t) for k, t in enumerate(texts)]


_RARE, _RUN = re.compile("[^\x00-ɏ]"), re.compile(r"\s{1000}")


@lru_cache(maxsize=1 << 16)
def _settled(c: str) -> bool:
    """Whether c has had its category since Unicode 3.2, so that patterns of libraries of different Unicode versions agree on it."""
    old = unicodedata.ucd_3_2_0.category(c)
    return old != "Cn" and old == unicodedata.category(c)


def plain(text: str) -> bool:
    """Whether text has only characters of a settled category and no run of white space that a backtracking pattern may give up on."""
    if len(text) >= 1000 and _RUN.search(text):
        return False
    return text.isascii() or not _RARE.search(text) or all(map(_settled, set(text)))


@lru_cache(maxsize=1)
def tokenizers(a: str, b: str, ranks: str | None) -> Tokenizers:
    return Tokenizers(a, b, ranks)


def union1d(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """numpy's union1d of two arrays in order: a stable sort merges them in linear time."""
    both = np.concatenate([left, right])
    both.sort(kind="stable")
    return both[np.diff(both, prepend=-1) > 0]


class Aligned:
    """Tokens and elementary intervals of several texts, laid end to end.

    a, b: ids; a_ends, b_ends: byte offsets; ends: of intervals; of_a, of_b: the tokens that own them; doc: their texts;
    shared: the ends that both tokenizers have; a_group, b_group: groups of tokens.
    """

    def __init__(self, own: Tokenizers, texts: list[str]):
        raw = [(" " + t).encode("utf-8", "replace") for t in texts]
        ids_a, ids_b = own.encode_a([" " + t for t in texts]), own.b.encode(texts, num_threads=1)
        for k, t in enumerate(texts):
            if not t or b"".join(map(own.a_bytes.__getitem__, ids_a[k])) != raw[k] or b"".join(map(own.b_bytes.__getitem__, ids_b[k])) != raw[k]:
                ids_a[k], ids_b[k], raw[k] = [], [], b""
        self.n_a, self.n_b = (np.array([len(x) for x in ids], np.int64) for ids in (ids_a, ids_b))
        self.a, self.b = (np.fromiter(chain.from_iterable(ids), np.int64, int(n.sum())) for ids, n in ((ids_a, self.n_a), (ids_b, self.n_b)))
        self.a_ends, self.b_ends = np.cumsum(own.a_len[self.a]), np.cumsum(own.b_len[self.b])
        self.ends = union1d(self.a_ends, self.b_ends)
        self.of_a, self.of_b = np.searchsorted(self.a_ends, self.ends), np.searchsorted(self.b_ends, self.ends)
        both = (self.a_ends[self.of_a] == self.ends) & (self.b_ends[self.of_b] == self.ends)
        self.shared = self.ends[both]
        to = np.cumsum([len(x) for x in raw])
        # a text without tokens ends where the one before it ends: the first of equal ends owns the bytes
        self.doc, self.shared_doc = np.searchsorted(to, self.ends), np.searchsorted(to, self.shared)
        self.a_group, self.b_group = np.searchsorted(self.shared, self.a_ends), np.searchsorted(self.shared, self.b_ends)

    def written(self, own: Tokenizers) -> list[str]:
        """Each text's groups as `a1,a2|b1;a3|b2,b3`."""
        key = np.concatenate([self.a_group * 2, self.b_group * 2 + 1])
        order = np.argsort(key, kind="stable")
        key, ids = key[order], np.concatenate([self.a, self.b])[order]
        step = np.diff(key, append=-1)
        end = np.where(step == 0, 1, np.where(key % 2 == 0, 2, 3))
        to = np.cumsum(self.n_a + self.n_b)
        end[(to - 1)[self.n_a > 0]] = 0
        parts = list(map(own.decimal.__getitem__, (end * own.most + ids).tolist()))
        return ["".join(parts[i:j]) for i, j in zip([0, *to[:-1].tolist()], to.tolist(), strict=True)]

    def products(self) -> tuple[np.ndarray, np.ndarray]:
        """Positions of the A and B tokens of every pair of a group: the groups' products, expanded without a loop."""
        per_a, per_b = (np.bincount(g, minlength=len(self.shared)) for g in (self.a_group, self.b_group))
        each = per_b[self.a_group]  # B tokens that each A token meets
        left = np.repeat(np.arange(len(self.a)), each)
        start = np.cumsum(per_b) - per_b
        return left, np.arange(len(left)) - np.repeat(np.cumsum(each) - each, each) + start[self.a_group[left]]


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and the sums of their counts."""
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.diff(keys, prepend=-1))
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


def _aligned(files: tuple, wide: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each text, with its distinct pairs, and apart from these rows the task's counts of texts by pair."""
        own, kind = tokenizers(*files), pa.int64() if wide else pa.int32()
        n_b, held, size = len(own.b_bytes), [], 0

        def lists(values: np.ndarray, at: np.ndarray, of) -> pa.Array:
            return pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(values, of))

        def counted(keys, counts) -> Iterator[pa.RecordBatch]:
            for k in range(0, len(keys), 1 << 16):
                part = slice(k, k + (1 << 16))
                own_lists = [lists(x[part], np.array([0, len(x[part])]), of) for x, of in ((keys, kind), (counts, pa.int32()))]
                empty = [pa.nulls(1, t) for t in (pa.int64(),) * 5 + (pa.string(),)]
                yield pa.RecordBatch.from_arrays([pa.array([False]), *empty, *own_lists], names=names)

        names = ["\0doc", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"]
        for batch in batches:
            for at, to in chunks(text_buffers(batch.column(1))[1], PIECE):
                part = batch.slice(at, to - at)
                n, x = to - at, Aligned(own, [t or "" for t in part.column(1).to_pylist()])
                digests = [hashlib.sha256(t.encode()).hexdigest() if t else "" for t in x.written(own)]
                links, groups = np.bincount(x.doc, minlength=n), np.bincount(x.shared_doc, minlength=n)
                bits = 62 if wide else 31
                if wide:  # a text at a time, for pair and text don't fit in one number
                    found = [np.unique(x.a[x.of_a[m]] * n_b + x.b[x.of_b[m]], return_counts=True) for m in (x.doc == k for k in range(n))]
                    sizes, pairs, times = [len(f[0]) for f in found], np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])
                else:
                    keys, times = np.unique((x.doc << bits) + x.a[x.of_a] * n_b + x.b[x.of_b], return_counts=True)
                    sizes, pairs = np.bincount(keys >> bits, minlength=n), keys & ((1 << bits) - 1)
                offsets = np.concatenate([[0], np.cumsum(sizes)])
                held.append(summed(pairs, np.ones(len(pairs), np.int64)))
                size += len(held[-1][0])
                numbers = [pa.array(c, pa.int64()) for c in (x.n_a, x.n_b, groups, links)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([True] * n), part.column(0), *numbers, pa.array(digests), lists(pairs, offsets, kind), lists(times, offsets, pa.int32())], names=names
                )
                if size > COUNTED:
                    held = [summed(*(np.concatenate(c) for c in zip(*held, strict=True)))]
                    size = len(held[0][0])
                    if size > COUNTED // 2:
                        yield from counted(*held[0])
                        held, size = [], 0
        if held:
            yield from counted(*summed(*(np.concatenate(c) for c in zip(*held, strict=True))))

    return tidy(run)


def _scored(hot, best, n_b: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """n_best and count_sum over the pairs whose counts every task has; the others are handed on."""
        keys, counts = hot.value
        top = best.value
        for batch in batches:
            pairs, times = (batch.column(k) for k in (6, 7))
            at = pairs.offsets.to_numpy() - pairs.offsets[0].as_py()
            key, n = pairs.flatten().to_numpy().astype(np.int64), times.flatten().to_numpy().astype(np.int64)
            where = np.searchsorted(keys, key)
            known = np.zeros(len(key), bool)
            known[where < len(keys)] = keys[where[where < len(keys)]] == key[where < len(keys)]
            count = np.zeros(len(key), np.int64)
            count[known] = counts[where[known]]
            is_best = known & (count == top[key // n_b])
            total = [np.concatenate([[0], np.cumsum(v)]) for v in (np.where(is_best, n, 0), count * n, ~known)]
            sums = [t[at[1:]] - t[at[:-1]] for t in total]
            rest = [pa.ListArray.from_arrays(pa.array(total[2][at], pa.int32()), pa.array(v[~known], of)) for v, of in ((key, pairs.type.value_type), (n, pa.int32()))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:6], batch.column(8), pa.array(sums[0]), pa.array(sums[1]), *rest], names=[*batch.schema.names[:6], "\0row", "n_best", "count_sum", "pairs", "times"])

    return tidy(run)


def align_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", a: str = "byte_bpe_50k.json", b: str = "piece_bpe_32k.model", ranks: str | None = "byte_bpe_50k.tiktoken", hot: int = HOT) -> DataFrame:
    """Per row of docs: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    A encodes a space and the text, B the text (it adds the space). Whole texts are encoded, and strings of special tokens
    are ordinary text. Null and empty texts, and those that a tokenizer doesn't give back byte by byte, have no tokens: zeros
    and ''. An id pair's count is the number of rows of docs that hold it linked, so repeated rows count each and repeat their
    result; null ids are ids like others. An empty table gives an empty result. Columns other than the two named ones are not read.

    ranks: A's vocabulary as a rank file (None: A's own library for all texts). hot: pairs whose counts are sent to every
    task, those of the highest counts; the rest meets its counts in a join, whose keys are rare by that choice.
    """
    spark = docs.sparkSession
    narrow_batches(spark)
    scratch, files = Scratch(spark), (a, b, ranks)
    own = tokenizers(*files)
    n_a, n_b = len(own.a_bytes), len(own.b_bytes)
    wide = n_a * n_b >= 1 << 31
    kind = "long" if wide else "int"
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    both = scratch.cut(rows.mapInArrow(_aligned(files, wide), f"`\0doc` boolean, {ALIGNED}, pairs array<{kind}>, times array<int>").withColumn("\0row", F.monotonically_increasing_id()))
    own_rows = both.filter("`\0doc`").drop("\0doc")
    counted = both.filter("not `\0doc`").select(F.explode(F.arrays_zip("pairs", "times")).alias("x")).groupBy(F.col("x.pairs").alias("pair")).agg(F.sum("x.times").alias("n"))
    counts = scratch.cut(counted.withColumn("a", F.expr(f"cast(pair div {n_b} as int)")))
    # one row for each A token at most
    top = np.zeros(n_a, np.int64)
    for r in counts.groupBy("a").agg(F.max("n").alias("n")).collect():
        top[r.a] = r.n
    least = _threshold(counts, hot)
    often = counts.filter(F.col("n") >= least).select("pair", "n").toPandas().sort_values("pair")  # hot rows at most
    broadcast = spark.sparkContext.broadcast
    scored = own_rows.mapInArrow(
        _scored(broadcast((often["pair"].to_numpy(np.int64), often["n"].to_numpy(np.int64))), broadcast(top), n_b),
        f"{ALIGNED}, `\0row` long, n_best long, count_sum long, pairs array<{kind}>, times array<int>",
    )
    result = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    if least <= 1:
        return scored.select(*result)
    scored = scratch.cut(scored)
    rare = counts.filter(F.col("n") < least).join(F.broadcast(counts.groupBy("a").agg(F.max("n").alias("top"))), "a").select("pair", "n", (F.col("n") == F.col("top")).alias("best"))
    links = scored.select("\0row", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("\0row", F.col("x.pairs").alias("pair"), F.col("x.times").alias("times"))
    more = links.join(rare.hint("merge"), "pair").groupBy("\0row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("more_best"), F.sum(F.col("n") * F.col("times")).alias("more_sum"))
    out = scored.drop("pairs", "times").join(more, "\0row", "left")
    return out.withColumns({"n_best": F.col("n_best") + F.coalesce("more_best", F.lit(0)), "count_sum": F.col("count_sum") + F.coalesce("more_sum", F.lit(0))}).select(*result)


def _threshold(counts: DataFrame, hot: int) -> int:
    """The least count that at most hot pairs reach, among the sixteenths of powers of two; 1 where no more pairs exist."""
    bins = {r[0]: r[1] for r in counts.groupBy(F.floor(F.log2("n") * 16).cast("int").alias("bin")).count().collect()}
    taken = 0
    for k in sorted(bins, reverse=True):
        taken += bins[k]
        if taken > hot:
            return int(np.floor(2 ** ((k + 1) / 16))) + 1
    return 1


def token_links(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", a: str = "byte_bpe_50k.json", b: str = "piece_bpe_32k.model", ranks: str | None = "byte_bpe_50k.tiktoken", products: bool = False) -> DataFrame:
    """Rows doc_id, a_pos, b_pos, a_id, b_id, start, end: the links of each text, with token positions and byte offsets.

    With products, all pairs of tokens of a group instead of those that overlap, with the group's bytes; groups of
    usual texts are words. Texts as in align_tokens; those without tokens have no rows.
    """
    narrow_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = tokenizers(a, b, ranks)
        for batch in batches:
            for doc, text in zip(batch.column(0), batch.column(1), strict=True):
                x = Aligned(own, [text.as_py() or ""])
                if products:
                    left, right = x.products()
                    to = x.shared[x.a_group[left]]
                    start = np.concatenate([[0], x.shared])[x.a_group[left]]
                else:
                    left, right, to = x.of_a, x.of_b, x.ends
                    start = np.concatenate([[0], to])[:-1]
                for k in range(0, len(left), 1 << 16):
                    part = slice(k, k + (1 << 16))
                    columns = [pa.array(c[part], pa.int64()) for c in (left, right, x.a[left], x.b[right], start, to)]
                    yield pa.RecordBatch.from_arrays([pa.array([doc.as_py()] * len(columns[0]), pa.int64()), *columns], names=["doc_id", "a_pos", "b_pos", "a_id", "b_id", "start", "end"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, a_pos long, b_pos long, a_id long, b_id long, start long, end long")


def op11_token_alignment(spark, sf_dir: str) -> DataFrame:
    return align_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"))
