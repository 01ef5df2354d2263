"""Toxicity: a support vector machine on a subsequence string kernel with Nystroem landmarks.

The kernel of two words sums over common subsequences of three characters, gaps allowed, each
weighted by the decay to the power of its spans; words are taken with marks at both ends. Gapped and
inserted-character spellings of an insult so stay close to it. A text is a bag of words: labelled
texts teach how sure a text's worst word must be by itself, and how its three worst words go together.

Landmarks are words of the training texts; a word's Nystroem features are its kernel values with them
times the inverse square root of the landmarks' own kernel matrix. Since subsequences are bounded in
span, the kernel has an explicit feature map, in which the machine is one weight for each
subsequence: words are scored with table look-ups, each distinct word once for a task.
"""

from __future__ import annotations

import heapq
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .sampling import bounded_sample, fold
from .scratch import narrow_batches
from .shingles import chunks, text_buffers

DECAY, SPAN, DIMENSIONS = 0.7, 6, 1 << 15
#: Words of a text that are looked at together, and the least decision that counts there.
WORST, FLOOR = 3, -1.0
#: Characters of a word that are taken at once; longer words are taken in windows that overlap by half.
WIDTH = 24
LANDMARKS, NEGATIVES, LOSS, COMMON = 320, 6_000, 1e-5, 100.0
#: Distinct words whose scores a task keeps; it starts anew beyond that.
KEPT = 600_000
_SHAPES = [(a, b) for b in range(2, SPAN) for a in range(1, b)]
_SPACED = re.compile(r"(?<!\w)\w(?:[^\w\s]?\s?[^\w\s]?\w(?!\w)){3,}")


@dataclass
class Model:
    weight: np.ndarray  # of each hashed subsequence
    bias: float
    several: np.ndarray  # calibration of the WORST words, and its shift
    alone: np.ndarray  # calibration of the worst word by itself, and its shift


def words_of(text: str) -> set[str]:
    """The distinct chunks between white space, lower-cased, and runs of spaced single characters as one."""
    lower = text.lower()
    found = set(lower.split())
    if sum(len(w) == 1 for w in found) > 2:
        found.update("".join(x.split()) for x in _SPACED.findall(lower))
    return found


def bare(word: str) -> str:
    return word if word.isalpha() else "".join(filter(str.isalpha, word))


def _codes(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows of the marked words as a matrix of characters, their lengths, and the word of each."""
    pieces, owner = [], []
    for k, w in enumerate(words):
        w = f"^{w}$"
        for at in range(0, max(1, len(w) - WIDTH // 2), WIDTH // 2):
            pieces.append(w[at : at + WIDTH])
            owner.append(k)
    size = np.array([len(p) for p in pieces])
    out = np.zeros((len(pieces), WIDTH), np.uint32)
    out[np.arange(WIDTH) < size[:, None]] = np.frombuffer("".join(pieces).encode("utf-32-le", "surrogatepass"), np.uint32)
    return out, size, np.array(owner)


def _subsequences(codes: np.ndarray, size: np.ndarray) -> Iterator[tuple[float, np.ndarray, np.ndarray]]:
    """For each shape its weight, the hashed subsequences at every start, and which starts are within the word."""
    code = codes.astype(np.uint64)
    for a, b in _SHAPES:
        h = code[:, : WIDTH - b] * np.uint64(0x9E3779B97F4A7C15)
        h = (h ^ (h >> np.uint64(31)) ^ code[:, a : WIDTH - b + a]) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(29)) ^ code[:, b:]) * np.uint64(0x94D049BB133111EB)
        yield DECAY ** (b + 1), (h >> np.uint64(49)).astype(np.int64), np.arange(WIDTH - b) < size[:, None] - b


def feature_map(words: list[str]) -> np.ndarray:
    """Normalised explicit features, one row for each window of each word (a short word is one window); for few words."""
    codes, size, _ = _codes(words)
    out = np.zeros((len(codes), DIMENSIONS), np.float32)
    rows = np.arange(len(codes))[:, None]
    for w, index, valid in _subsequences(codes, size):
        np.add.at(out, (np.broadcast_to(rows, index.shape)[valid], index[valid]), w)
    return out / np.maximum(np.sqrt((out**2).sum(1, keepdims=True)), 1e-9)


def kernel(words: list[str], basis: np.ndarray) -> np.ndarray:
    """Normalised kernel values of the windows of words with the rows of basis, by their features."""
    codes, size, _ = _codes(words)
    columns = np.ascontiguousarray(basis.T)
    out, norm = np.zeros((len(codes), len(basis)), np.float32), np.zeros(len(codes))
    for w, index, valid in _subsequences(codes, size):
        norm += w * w * valid.sum(1)
        for k in range(index.shape[1]):
            rows = np.flatnonzero(valid[:, k])
            out[rows] += np.float32(w) * columns[index[rows, k]]
    return out / np.maximum(np.sqrt(norm), 1e-9)[:, None]


def centre(words: list[str]) -> np.ndarray:
    """The direction of the sum of the words' features."""
    out = np.zeros(DIMENSIONS)
    for w, index, valid in _subsequences(*_codes(words)[:2]):
        out += w * np.bincount(index[valid], minlength=DIMENSIONS)
    return out / max(1e-9, np.linalg.norm(out))


def decide(words: list[str], weight: np.ndarray, bias: float) -> np.ndarray:
    """The machine's decision for each word: that of its highest window."""
    out = np.full(len(words), -np.inf)
    for at in range(0, len(words), 8192):
        codes, size, owner = _codes(words[at : at + 8192])
        total, norm = np.zeros(len(codes)), np.zeros(len(codes))
        for w, index, valid in _subsequences(codes, size):
            total += w * np.where(valid, weight[index], 0).sum(1)
            norm += w * w * valid.sum(1)
        np.maximum.at(out, at + owner, total / np.maximum(np.sqrt(norm), 1e-9) + bias)
    return out


def fit(texts: list[str], toxic: np.ndarray, importance: np.ndarray) -> Model | None:
    """texts with labels 0 or 1; importance: of each text in the calibration. None if a label is missing."""
    if not len(texts) or not 0 < toxic.sum() < len(toxic):
        return None
    bags = [{b for b in map(bare, words_of(t)) if len(b) > 2} for t in texts]
    seen = (Counter(), Counter())
    for bag, y in zip(bags, toxic.tolist(), strict=True):
        seen[y].update(bag)
    base = toxic.mean()
    vocabulary = sorted(set(seen[0]) | set(seen[1]))
    t, n = np.array([seen[1][w] for w in vocabulary]), np.array([seen[0][w] + seen[1][w] for w in vocabulary])
    share = np.clip(t / n, 1e-9, 1 - 1e-9)
    evidence = n * (share * np.log(share / base) + (1 - share) * np.log((1 - share) / (1 - base)))
    # words whose excess in toxic texts isn't chance, given how many words were looked at
    chosen = np.flatnonzero((share > base) & (evidence > math.log(len(vocabulary)) - 1))
    if not len(chosen):
        chosen = np.argsort(-evidence * (share > base), kind="stable")[:5]
    positive = [vocabulary[i] for i in chosen]
    clean = [vocabulary[i] for i in np.flatnonzero(share < max(base, 0.3))]
    close = decide(clean, centre(positive), 0) if clean else np.zeros(0)
    hard = [clean[i] for i in np.argsort(-close, kind="stable")[: NEGATIVES // 3]]
    spread = clean[:: max(1, len(clean) // (2 * NEGATIVES // 3))][: 2 * NEGATIVES // 3]
    negative = sorted(set(hard) | set(spread))
    best = [positive[i] for i in np.argsort(-evidence[chosen], kind="stable")[: LANDMARKS // 2]]
    known = dict(zip(vocabulary, n.tolist(), strict=True))
    common = sorted(hard[:1000], key=lambda w: (-known[w], w))
    landmarks = best + common[: LANDMARKS // 4] + spread[:: max(1, len(spread) * 4 // LANDMARKS)][: LANDMARKS // 4]
    basis = feature_map(landmarks)
    values, vectors = np.linalg.eigh((basis @ basis.T).astype(float))
    root = vectors / np.sqrt(np.maximum(values, 1e-6)) @ vectors.T
    # spellings with one more character inside, for words long enough to be known by the rest
    spelt = {w[:k] + "xzqjk"[(i + k) % 5] + w[k:]: w for i, w in enumerate(best) if len(w) > 4 for k in range(1, len(w))}
    known |= {v: 0.5 * known[w] / len(w) for v, w in spelt.items()}
    positive = positive + sorted(spelt)
    instances = positive + negative
    z = (kernel(instances, basis) @ root.astype(np.float32)).astype(np.float32)
    of_word = _codes(instances)[2]  # a row is a window
    y = np.where(of_word < len(positive), 1.0, -1.0)
    # a word that many texts have says more, on either side; very common clean ones are far off anyway
    cost = (np.minimum([known[w] for w in instances], COMMON) / np.bincount(of_word))[of_word]
    cost *= 0.5 / cost[y > 0].sum()
    v, bias, total, of = np.zeros(z.shape[1], np.float32), 0.0, np.zeros(z.shape[1] + 1), 0
    cost = cost.astype(np.float32)
    for step in range(1, 2001):  # subgradients of the hinge loss, averaged over the second half
        rate = min(40.0, 1 / (LOSS * (step + 100)))
        inside = (z @ v + bias) * y < 1
        v += np.float32(rate) * ((cost * inside * y).astype(np.float32) @ z - np.float32(LOSS) * v)
        bias += 0.05 * rate * (cost * inside * y).sum()
        if step > 1000:
            total[:-1] += v
            total[-1] += bias
            of += 1
    v, bias = total[:-1] / of, total[-1] / of
    weight = (root @ v) @ basis.astype(float)
    score = dict(zip(vocabulary, decide(vocabulary, weight, bias), strict=True))
    top = worst([[score[w] for w in bag] for bag in bags])
    return Model(weight.astype(np.float32), float(bias), calibrated(np.maximum(top, FLOOR), toxic, importance), calibrated(top[:, :1], toxic, importance))


def worst(decisions: list[list[float]]) -> np.ndarray:
    """The WORST highest decisions of each text, the highest first; -3 where it has fewer words."""
    out = np.full((len(decisions), WORST), -3.0)
    for row, own in zip(out, decisions, strict=True):
        few = heapq.nlargest(WORST, own)
        row[: len(few)] = few
    return out


def calibrated(x: np.ndarray, toxic: np.ndarray, importance: np.ndarray) -> np.ndarray:
    """Weights of a logistic regression of the labels on the columns of x, the last one its shift: Newton steps."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    few = np.append(np.full(len(w) - 1, 1e-3), 0.0)
    for _ in range(200):
        p = 1 / (1 + np.exp(-(x @ w).clip(-30, 30)))
        gradient = x.T @ (importance * (toxic - p)) - few * w
        curve = (x.T * (importance * p * (1 - p))) @ x + 1e-3 * np.eye(len(w))
        w = w + np.linalg.solve(curve, gradient).clip(-1, 1)
    return w


def probability(model: Model, top: np.ndarray) -> np.ndarray:
    """Of texts, by what worst() tells of them: the higher of both calibrations."""
    odds = np.maximum(np.maximum(top, FLOOR) @ model.several[:-1] + model.several[-1], top[:, :1] @ model.alone[:-1] + model.alone[-1])
    return 1 / (1 + np.exp(-odds.clip(-50, 50)))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", folds: int = 5, most: int = 3000) -> Model | None:
    """Fits on labelled texts of folds other than 0: a sample of about most texts for each label, by a hash of the
    id, which are weighted by what they stand for. Texts are whole; null labels and null texts are left out."""
    labels = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("toxic")).filter("toxic in (0, 1) and id is not null")
    labels = labels.filter(fold("id", folds) != 0)
    counts = {r[0]: r[1] for r in labels.groupBy("toxic").count().collect()}
    ids = bounded_sample(labels, "toxic", "id", most)  # about 2 * most rows: a bound for the broadcast
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(ids), "id").filter("text is not null").orderBy("id").select("text", "toxic").toPandas()
    toxic = rows["toxic"].to_numpy(int)
    got = np.bincount(toxic, minlength=2)
    weight = np.array([counts.get(k, 0) / max(1, got[k]) for k in (0, 1)])
    return fit(rows["text"].tolist(), toxic, weight[toxic] / max(1e-9, weight[toxic].mean()) if len(toxic) else np.zeros(0))


class Scorer:
    def __init__(self, model: Model):
        self.model, self.known = model, {}

    def __call__(self, texts: list[str]) -> np.ndarray:
        bags = [words_of(t) for t in texts]
        if len(self.known) > KEPT:
            self.known.clear()
        new = set().union(*bags).difference(self.known) if bags else set()
        if new:
            forms = list(new)
            plain = list({b for b in map(bare, forms) if len(b) > 2})
            score = dict(zip(plain, decide(plain, self.model.weight, self.model.bias).tolist(), strict=True)) if plain else {}
            self.known.update((f, score.get(bare(f), -3.0)) for f in forms)
        get = self.known.__getitem__
        return probability(self.model, worst([[get(w) for w in bag] for bag in bags]))


def _score(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        own = model and Scorer(model)
        for batch in batches:
            for at, to in chunks(text_buffers(batch.column(1))[1], 1 << 22):
                texts = [t or "" for t in batch.column(1).slice(at, to - at).to_pylist()]
                score = own(texts) if own else np.zeros(len(texts))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, to - at), pa.array(score)], names=["doc_id", "score"])

    return run


def toxicity(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: doc_id, score, predicted.

    score is the calibrated probability of label 1. A null text is an empty one; it has no word and the
    score of a bag without one. Without a model (no row of either label to learn from) all scores are 0.
    Repeated rows repeat their result; an empty table gives an empty one. Other columns are not read.
    """
    narrow_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    sent = docs.sparkSession.sparkContext.broadcast(model)  # DIMENSIONS weights
    return rows.mapInArrow(_score(sent), "doc_id long, score double").withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op7_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = toxicity(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return out.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", "predicted")
