"""LM scoring with a hashed maximum-entropy model.

The softmax is factored by classes: a word's probability is that of its class, given hashed features
of the words before it (the last word, the one before that as a skip feature, and the two as an
n-gram), times that of the word in its class. The few most frequent words are classes of their own;
other words are classed by their first two bytes, which are clustered by what stands before them.
In a class, the features are the words alone, for which maximum entropy has a closed form: counts plus
one, with one place for all unknown words.

Counts cover the whole training corpus and stay distributed. The tables of feature weights grow with the
corpus up to a bound: their rows follow the numbers of distinct words and bigrams, so that as many features share a
row at any size within it. The class layer is trained in one pass by distributed gradient updates: each task takes minibatch
steps over its documents, and the tasks' weights are averaged row by row, weighted by the tokens that used the
row in each. Texts are scored in sparse numpy batches. Counts of the most
frequent words, a bounded number, travel to the texts; the rare words of the texts travel to the counts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .sampling import fold
from .scratch import Scratch, narrow_batches
from .shingles import _LOWER, chunks, hash_spans, mix, text_buffers, word_spans

CLASSES, OWN = 32, 16
#: Buckets of a word's first two bytes, least rows of weights for each kind of feature, kinds, and tokens of a minibatch.
PREFIXES, ROWS, KINDS, BATCH = 1024, 1 << 14, 3, 1 << 14
#: Most distinct words and bigrams for a row of weights, on average; registers of the count of distinct bigrams.
WORDS_A_ROW, BIGRAMS_A_ROW, REGISTERS = 128, 4096, 1 << 12
#: Most rows of weights of a kind: with three kinds the weights have 384 MB at most, which are sent to every worker. Beyond that more features share a row.
MOST_ROWS = 1 << 20
#: Training tasks for each core: each has weights of its own, so their number must not grow with the input.
TASKS = 4
#: Most words whose counts are sent to the texts.
HEAD = 1 << 20
#: Tokens that a task counts at once, and weight rows in a piece of the average.
COUNTED, PIECE, SALTS = 1 << 22, 1 << 8, 16
END = np.uint64(0x5E0FD0C5E0FD0C5E)
RATE = np.float32(0.5)


def token_chunks(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """For ranges of texts: first, end, the tokens' hashes and prefix buckets, and the offsets of each text's tokens; each text ends in END."""
    data, offsets = text_buffers(texts)
    for at, to in chunks(offsets):
        part = _LOWER[data[offsets[at] : offsets[to]]]
        cuts = offsets[at : to + 1] - offsets[at]
        starts, ends = word_spans(part, cuts)
        count = np.searchsorted(starts, cuts)
        shifted = count + np.arange(len(count))  # one more token for each text before
        tokens, prefix = np.full(shifted[-1], END, np.uint64), np.zeros(shifted[-1], np.int16)
        place = np.arange(len(starts)) + np.searchsorted(count[1:], np.arange(len(starts)), "right")
        tokens[place] = hash_spans(part, starts, ends)
        if len(starts):
            second = np.where(ends - starts > 1, part[np.minimum(starts + 1, len(part) - 1)], 0).astype(np.int32)
            prefix[place] = 1 + (part[starts].astype(np.int32) * 193 + second * 7) % (PREFIXES - 1)
        yield at, to, tokens, prefix, shifted


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of a task's tokens (kind 0, with the prefix bucket), of pairs of prefix buckets (kind 1), and registers of its distinct bigrams (kind 2), piece by piece."""
    held, pairs, size = [], np.zeros(PREFIXES * PREFIXES, np.int64), 0
    registers = np.zeros(REGISTERS, np.int64)

    def out(kind, key, of, n):
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(key), kind, np.int8)), pa.array(key), pa.array(of.astype(np.int16)), pa.array(n.astype(np.int64))], names=["kind", "key", "prefix", "n"])

    def counted():
        tokens, prefix = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.argsort(tokens)
        tokens = tokens[order]
        first = np.flatnonzero(np.concatenate([[True], tokens[1:] != tokens[:-1]]))
        return out(0, tokens[first].view(np.int64), prefix[order[first]], np.diff(np.append(first, len(tokens))))

    for batch in batches:
        for _, _, tokens, prefix, cuts in token_chunks(batch.column(0)):
            held.append((tokens, prefix))
            size += len(tokens)
            before = np.concatenate([[0], prefix[:-1]]).astype(np.int64)
            before[cuts[:-1]] = 0
            code, n = np.unique(before * PREFIXES + prefix, return_counts=True)
            pairs[code] += n
            _register(registers, bigrams(*before_each(tokens, cuts)))
            if size >= COUNTED:
                yield counted()
                held, size = [], 0
    if size:
        yield counted()
    full = np.flatnonzero(pairs)
    if len(full):
        yield out(1, full, np.zeros(len(full)), pairs[full])
    full = np.flatnonzero(registers)
    if len(full):
        yield out(2, full, np.zeros(len(full)), registers[full])


def _register(registers: np.ndarray, hashes: np.ndarray) -> None:
    """HyperLogLog: each register keeps the highest rank of the first set bit among its hashes."""
    bits = 64 - (REGISTERS - 1).bit_length()
    _, length = np.frexp((hashes >> np.uint64(64 - bits)).astype(np.float64))
    np.maximum.at(registers, (hashes & np.uint64(REGISTERS - 1)).astype(np.int64), (bits + 1 - length).astype(np.int64))


def distinct_of(registers: np.ndarray) -> int:
    """About how many distinct hashes the registers have seen (standard error 1.6 %)."""
    n, empty = len(registers), int(np.count_nonzero(registers == 0))
    found = 0.7213 / (1 + 1.079 / n) * n * n / np.exp2(-registers.astype(float)).sum()
    return round(n * np.log(n / empty) if empty and found <= 2.5 * n else found)


def table_sizes(words: int, bigrams: int) -> tuple[int, int]:
    """Rows of weights (powers of two) for features of one word and for those of two: MOST_ROWS of each kind at most."""
    fit = lambda n, load: min(MOST_ROWS, max(ROWS, 1 << (-(-n // load) - 1).bit_length()))
    return fit(words, WORDS_A_ROW), fit(bigrams, BIGRAMS_A_ROW)


@dataclass
class Classes:
    own: np.ndarray  # sorted hashes of the words that are classes
    own_class: np.ndarray
    of_prefix: np.ndarray

    def __call__(self, tokens: np.ndarray, prefix: np.ndarray) -> np.ndarray:
        place = np.searchsorted(self.own, tokens).clip(max=len(self.own) - 1)
        return np.where(self.own[place] == tokens, self.own_class[place], self.of_prefix[prefix])


def cluster(pairs: np.ndarray, k: int) -> np.ndarray:
    """k clusters of the rows' prefix buckets by the distribution of the bucket before (k-means on its square roots)."""
    weight = pairs.sum(1)
    points = np.sqrt(pairs / np.maximum(weight, 1)[:, None])
    out = np.zeros(len(pairs), np.int64)
    full = np.flatnonzero(weight)
    if not len(full):
        return out
    chosen = [full[np.argmax(weight[full])]]
    near = np.full(len(full), np.inf)
    while len(chosen) < min(k, len(full)):  # farthest first, by weight
        near = np.minimum(near, ((points[full] - points[chosen[-1]]) ** 2).sum(1))
        chosen.append(full[np.argmax(near * np.sqrt(weight[full]))])
    centres = points[chosen]
    for _ in range(20):
        own = ((points[full] ** 2).sum(1)[:, None] - 2 * points[full] @ centres.T + (centres**2).sum(1)).argmin(1)
        for c in range(len(centres)):
            if (rows := full[own == c]).size:
                centres[c] = (points[rows] * weight[rows, None]).sum(0) / weight[rows].sum()
    out[full] = own
    return out


def before_each(tokens: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The last word before each token and the one before that; 0 where the text begins."""
    first, second = np.zeros(len(tokens), np.uint64), np.zeros(len(tokens), np.uint64)
    first[1:], second[2:] = tokens[:-1], tokens[:-2]
    starts = cuts[:-1][np.diff(cuts) > 0]
    first[starts] = 0
    second[starts] = 0
    after = starts + 1
    second[after[after < len(tokens)]] = 0
    return first, second


def bigrams(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return mix(first * np.uint64(0x9E3779B97F4A7C15) + second)


def feature_rows(tokens: np.ndarray, cuts: np.ndarray, sizes: tuple[int, int]) -> np.ndarray:
    """The rows of weights of each token's features: last word, skip, n-gram of both. sizes: as of table_sizes()."""
    first, second = before_each(tokens, cuts)
    out = np.empty((len(tokens), KINDS), np.int32)
    low, low2 = (np.uint64(n - 1) for n in sizes)
    out[:, 0] = (first >> np.uint64(7)) & low
    out[:, 1] = (sizes[0] + ((mix(second + np.uint64(1)) >> np.uint64(9)) & low).astype(np.int64)).astype(np.int32)
    out[:, 2] = (2 * sizes[0] + ((bigrams(first, second) >> np.uint64(11)) & low2).astype(np.int64)).astype(np.int32)
    return out


def log_classes(weights: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Natural logarithms of the class probabilities. The last row of weights is the bias."""
    z = weights[rows[:, 0]] + weights[-1]
    for k in range(1, KINDS):
        z += weights[rows[:, k]]
    z -= z.max(1, keepdims=True)
    return z - np.log(np.exp(z).sum(1, keepdims=True))


def descend(weights: np.ndarray, squares: np.ndarray, used: np.ndarray, rows: np.ndarray, label: np.ndarray) -> None:
    """One minibatch step; rates fall with each row's squared gradients so far. used: tokens that had the row."""
    gap = np.exp(log_classes(weights, rows))
    gap[np.arange(len(label)), label] -= 1
    for k in range(KINDS):
        order = np.argsort(rows[:, k], kind="stable")
        sorted_ = rows[order, k]
        first = np.flatnonzero(np.concatenate([[True], sorted_[1:] != sorted_[:-1]]))
        step = np.add.reduceat(gap[order], first, axis=0)
        at = sorted_[first]
        used[at] += np.diff(np.append(first, len(sorted_)))
        squares[at] += (step * step).mean(1)
        weights[at] -= (RATE / np.sqrt(squares[at] + 1))[:, None] * step
    step = gap.sum(0)
    used[-1] += len(label)
    squares[-1] += (step * step).mean()
    weights[-1] -= RATE / np.sqrt(squares[-1] + 1) * step


def _train(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A task's weights, each row times the tokens that used it and with their number, in pieces."""
        classes, sizes = sent.value
        salt = TaskContext.get().partitionId() % SALTS
        n = 2 * sizes[0] + sizes[1] + 1
        weights, squares, used = np.zeros((n, CLASSES), np.float32), np.zeros(n, np.float32), np.zeros(n, np.int64)
        for batch in batches:
            for _, _, tokens, prefix, cuts in token_chunks(batch.column(0)):
                rows, label = feature_rows(tokens, cuts, sizes), classes(tokens, prefix)
                for at in range(0, len(label), BATCH):
                    descend(weights, squares, used, rows[at : at + BATCH], label[at : at + BATCH])
        for piece in range(0, n, PIECE):
            times = used[piece : piece + PIECE, None].astype(np.float64)
            if times.any():
                value = np.hstack([weights[piece : piece + PIECE] * times, times])
                yield pa.RecordBatch.from_arrays([pa.array([piece], pa.int64()), pa.array([salt], pa.int64()), pa.array([value.astype(np.float32).tobytes()], pa.binary())], names=["piece", "salt", "value"])

    return run


def _sum(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces of the same name in a task added up: the lower level of the average."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for piece, value in zip(*(batch.column(k).to_pylist() for k in (0, 2)), strict=True):
            value = np.frombuffer(value, np.float32)
            sums[piece] = sums[piece] + value if piece in sums else value.astype(np.float64)
    for piece, value in sums.items():
        yield pa.RecordBatch.from_arrays([pa.array([piece], pa.int64()), pa.array([value.astype(np.float32).tobytes()], pa.binary())], names=["piece", "value"])


def _average(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for piece, value in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            value = np.frombuffer(value, np.float32).astype(np.float64)
            sums[piece] = sums[piece] + value if piece in sums else value
    for piece, value in sums.items():
        value = value.reshape(-1, CLASSES + 1)
        mean = value[:, :-1] / np.maximum(value[:, -1:], 1)
        yield pa.RecordBatch.from_arrays([pa.array([piece], pa.int64()), pa.array([mean.astype(np.float32).tobytes()], pa.binary())], names=["piece", "value"])


@dataclass
class Model:
    classes: Classes
    sizes: tuple[int, int]  # rows of weights, as of table_sizes()
    weights: np.ndarray
    head: np.ndarray  # sorted hashes of frequent words
    head_log: np.ndarray  # log10(count + 1)
    within: np.ndarray  # log10 of each class's places: tokens + words + 1
    tokens: int
    words: int


def train(docs: DataFrame, scratch: Scratch, text_col: str = "text") -> tuple[Model, DataFrame]:
    """The model of the texts of docs, and the table of counts: key, n."""
    narrow_batches(docs.sparkSession)
    texts = docs.select(F.col(text_col).cast("string").alias("text"))
    raw = texts.mapInArrow(_count, "kind byte, key long, prefix short, n long")
    counts = scratch.cut(raw.groupBy("kind", "key").agg(F.when(F.col("kind") == 2, F.max("n")).otherwise(F.sum("n")).alias("n"), F.min("prefix").alias("prefix")))
    words = counts.filter("kind = 0")
    spark = docs.sparkSession
    pairs = np.zeros(PREFIXES * PREFIXES)
    seen = counts.filter("kind = 1").select("key", "n").toPandas()  # at most PREFIXES squared
    pairs[seen["key"].to_numpy(int)] = seen["n"].to_numpy(float)
    top = words.orderBy(F.desc("n"), "key").limit(OWN).select("key").toPandas()["key"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(top)
    of_prefix = OWN + cluster(pairs.reshape(PREFIXES, PREFIXES).T, CLASSES - OWN)
    classes = Classes(top[order] if len(top) else np.zeros(1, np.uint64), order if len(top) else np.zeros(1, int), of_prefix)

    by_prefix = words.groupBy("prefix").agg(F.sum("n").alias("n"), F.count("*").alias("words")).toPandas()
    tokens_of, words_of = np.zeros(CLASSES), np.zeros(CLASSES)
    np.add.at(tokens_of, of_prefix[by_prefix["prefix"].to_numpy(int)], by_prefix["n"].to_numpy(float))
    np.add.at(words_of, of_prefix[by_prefix["prefix"].to_numpy(int)], by_prefix["words"].to_numpy(float))
    mine = words.filter(F.col("key").isin([int(x) for x in top.view(np.int64)])).select("key", "n", "prefix").collect() if len(top) else []
    for r in mine:
        c = int(classes(np.array([r["key"]], np.int64).view(np.uint64), np.array([r["prefix"]]))[0])
        tokens_of[of_prefix[r["prefix"]]] -= r["n"]
        words_of[of_prefix[r["prefix"]]] -= 1
        tokens_of[c], words_of[c] = r["n"], 1
    # the largest threshold's worth of words that HEAD holds, by a histogram of at most 64 * 16 bins
    bins = words.groupBy(F.floor(F.log2("n") * 16).cast("int").alias("bin")).agg(F.count("*").alias("words"), F.min("n").alias("least")).toPandas().sort_values("bin", ascending=False)
    fits = bins[bins["words"].cumsum() <= HEAD]
    least = int(fits["least"].min()) if len(fits) else 1 << 62
    head = words.filter(F.col("n") >= least).select("key", "n").toArrow()  # at most HEAD rows
    key, n = head.column("key").to_numpy().astype(np.int64).view(np.uint64), head.column("n").to_numpy()
    order = np.argsort(key)

    total = int(by_prefix["n"].sum()) if len(by_prefix) else 0
    n_words = int(by_prefix["words"].sum()) if len(by_prefix) else 0
    registers = np.zeros(REGISTERS, np.int64)
    for r in counts.filter("kind = 2").select("key", "n").collect():  # at most REGISTERS
        registers[r["key"]] = r["n"]
    sizes = table_sizes(n_words, distinct_of(registers))
    sent = spark.sparkContext.broadcast((classes, sizes))
    dealt = texts.coalesce(TASKS * spark.sparkContext.defaultParallelism)
    pieces = dealt.mapInArrow(_train(sent), "piece long, salt long, value binary").repartition("piece", "salt").mapInArrow(_sum, "piece long, value binary").repartition("piece").mapInArrow(_average, "piece long, value binary")
    weights = np.zeros((2 * sizes[0] + sizes[1] + 1, CLASSES), np.float32)
    for r in pieces.toLocalIterator():  # the weights of one model
        value = np.frombuffer(r["value"], np.float32).reshape(-1, CLASSES)
        weights[r["piece"] : r["piece"] + len(value)] = value
    within = np.log10(tokens_of + words_of + 1)
    return Model(classes, sizes, weights, key[order], np.log10(n[order] + 1.0), within, total, n_words), words.select("key", "n")


SCORED = "row long, doc_id long, n_tokens long, n_known long, logs double, given double, key long, times long"


def _score(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """For each text a row with what the model and the frequent words say, and a row for each of its rare words (key, times)."""
        model: Model = sent.value
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            for at, to, tokens, prefix, cuts in token_chunks(batch.column(1)):
                n, sizes = to - at, np.diff(cuts)
                given = np.empty(len(tokens))
                rows, label = feature_rows(tokens, cuts, model.sizes), model.classes(tokens, prefix)
                for k in range(0, len(tokens), BATCH):
                    own = label[k : k + BATCH]
                    given[k : k + BATCH] = log_classes(model.weights, rows[k : k + BATCH])[np.arange(len(own)), own]
                given = given / np.log(10) - model.within[label]
                known, logs = np.zeros(len(tokens), bool), np.zeros(len(tokens))
                if len(model.head):
                    place = np.searchsorted(model.head, tokens).clip(max=len(model.head) - 1)
                    known = model.head[place] == tokens
                    logs = np.where(known, model.head_log[place], 0.0)
                own = row + np.arange(n)
                sums = [np.add.reduceat(x, cuts[:-1]) for x in (known.astype(np.int64), logs, given)]
                yield _rows(own, batch.column(0).slice(at, n), sizes, sums[0], sums[1], sums[2], None, None)
                rare = np.flatnonzero(~known)
                if len(rare):
                    of, key = np.repeat(np.arange(n), sizes)[rare], tokens[rare]
                    order = np.lexsort((key, of))
                    of, key = of[order], key[order]
                    first = np.flatnonzero(np.concatenate([[True], (of[1:] != of[:-1]) | (key[1:] != key[:-1])]))
                    yield _rows(own[of[first]], None, None, None, None, None, key[first].view(np.int64), np.diff(np.append(first, len(of))))
                row += n

    return run


def _rows(row, *columns) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int64(), pa.int64()]
    made = [pa.nulls(len(row), t) if c is None else c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(columns, kinds, strict=True)]
    return pa.RecordBatch.from_arrays([pa.array(row, pa.int64()), *made], names=[x.split()[0] for x in SCORED.split(", ")])


def score(docs: DataFrame, model: Model, counts: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: doc_id, n_tokens, n_known, train_tokens, base_score, score (log10 probabilities).

    A null text is an empty one, whose only token is the end. Repeated rows repeat their result; an empty table
    gives an empty one. Without training texts every token is unknown. Other columns are not read.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    sent = docs.sparkSession.sparkContext.broadcast(model)  # HEAD counts and the weights of KINDS * MOST_ROWS rows at most
    both = scratch.cut(rows.mapInArrow(_score(sent), SCORED))
    found = both.filter("key is not null").select("row", "key", "times").join(counts, "key")
    rare = found.groupBy("row").agg(F.sum("times").alias("known"), F.sum(F.col("times") * F.log10(F.col("n") + 1)).alias("rare"))
    out = both.filter("n_tokens is not null").drop("key", "times").join(rare, "row", "left")
    logs = F.col("logs") + F.coalesce("rare", F.lit(0.0))
    places = F.log10(F.lit(float(model.tokens + model.words + 1)))
    return out.select(
        "doc_id",
        "n_tokens",
        (F.col("n_known") + F.coalesce("known", F.lit(0))).alias("n_known"),
        F.lit(model.tokens).cast("long").alias("train_tokens"),
        (logs - F.col("n_tokens") * places).alias("base_score"),
        (logs + F.col("given")).alias("score"),
    )


def op10_lm_score(spark, sf_dir: str) -> DataFrame:
    docs, scratch = spark.read.parquet(f"{sf_dir}/documents.parquet"), Scratch(spark)
    model, counts = train(docs.filter(fold("doc_id", 7) != 2), scratch)
    out = score(docs, model, counts, scratch)
    return out.select("doc_id", (fold("doc_id", 7) == 2).alias("held_out"), *out.columns[1:])
