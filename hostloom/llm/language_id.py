"""Language ID by prediction by partial matching.

Each language has a context tree over bytes of variable order, ORDER at most: a context's symbols are coded by
their counts, and an escape with the mass of the number of distinct symbols (method C) goes on to the
next shorter context, where the symbols that were not escaped from are excluded. The trees are
frozen after training, so a text's exact code length is a sum over its positions.

The trees of all languages lie over one another. What an unseen symbol pays in a context, the escape and the exclusion
together, is the same for all of them, so a context has one such number for each language, and one for each symbol that
any language has seen in it. A text is scored by looking its contexts up from the longest down, in numpy, piece by piece.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .sampling import bounded_sample, fold
from .scratch import narrow_batches, tidy
from .shingles import chunks, text_buffers

ORDER = 5
#: A context is in the tree if the training texts have it LEAST times; the tree of an order holds the CELLS / languages
#: most frequent ones, so that a model is bounded however many languages there are.
LEAST, CELLS = 2, 1 << 18
#: Bytes that are scored at once.
PIECE = 1 << 16
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
UNDETERMINED = "und"
NAMES = ("doc_id", "lang_pred", "score")
_NONE = np.uint64((1 << 64) - 1)


class Places:
    """The place of a number in a list of distinct ones, or -1: open addressing with linear probing."""

    def __init__(self, numbers: np.ndarray):
        bits = max(4, (2 * len(numbers)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.number, self.place = np.full(1 << bits, _NONE), np.full(1 << bits, -1, np.int32)
        left = np.arange(len(numbers))
        at = self._home(numbers)
        while len(left):
            free = np.flatnonzero(self.number[at] == _NONE)
            won = free[np.unique(at[free], return_index=True)[1]]
            self.number[at[won]], self.place[at[won]] = numbers[left[won]], left[won]
            lost = np.ones(len(left), bool)
            lost[won] = False
            left, at = left[lost], (at[lost] + 1) & self.mask

    def _home(self, numbers: np.ndarray) -> np.ndarray:
        return ((numbers * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def __call__(self, numbers: np.ndarray) -> np.ndarray:
        at = self._home(numbers)
        there = self.number[at]
        out = np.where(there == numbers, self.place[at], np.int32(-1))
        left = np.flatnonzero((there != numbers) & (there != _NONE))
        at = at[left]
        while len(left):
            at = (at + 1) & self.mask
            there = self.number[at]
            hit = there == numbers[left]
            out[left[hit]] = self.place[at[hit]]
            on = ~hit & (there != _NONE)
            left, at = left[on], at[on]
        return out


@dataclass
class Level:
    """The contexts of one order."""

    symbol: Places  # of a context with the symbol after it
    bits: np.ndarray  # of each of these, by language
    context: Places
    escape: np.ndarray  # bits of escape and exclusion of each context, by language


@dataclass
class Model:
    languages: list[str]
    alone: np.ndarray  # bits of each byte without a context, by language
    levels: list[Level]  # orders 1 and up


def _low(numbers: np.ndarray, k: int) -> np.ndarray:
    """The last k bytes."""
    return numbers & np.uint64((1 << 8 * k) - 1)


def _with_contexts(data: np.ndarray, at: int, to: int, place: np.ndarray) -> np.ndarray:
    """Each byte from at to to, which stands at place in its text, after the ORDER bytes before it, as one number. Before a text are line ends."""
    first = max(0, at - ORDER)
    held = np.concatenate([np.full(ORDER - (at - first), 10, np.uint8), data[first:to]])
    out = np.zeros(to - at, np.uint64)
    for k in range(ORDER + 1):
        before = held[ORDER - k : len(held) - k].astype(np.uint64)
        before[place < k] = 10
        out |= before << np.uint64(8 * k)
    return out


def _pieces(data: np.ndarray, cuts: np.ndarray) -> Iterator[tuple[np.ndarray, int, np.ndarray]]:
    """For each piece of data: its bytes with contexts, its first text, and how many bytes each text from there on has in it."""
    for at in range(0, len(data), PIECE):
        to = min(at + PIECE, len(data))
        first, end = int(np.searchsorted(cuts, at, "right")) - 1, int(np.searchsorted(cuts, to, "left"))
        sizes = np.minimum(cuts[first + 1 : end + 1], to) - np.maximum(cuts[first:end], at)
        yield _with_contexts(data, at, to, np.arange(at, to) - np.repeat(cuts[first:end], sizes)), first, sizes


def _costs(alone: np.ndarray, levels: list[Level], numbers: np.ndarray) -> np.ndarray:
    """Bits of each byte, by language, in the longest of its contexts that the levels hold."""
    out, left = np.zeros((len(numbers), alone.shape[1]), alone.dtype), np.arange(len(numbers))
    for k in range(len(levels), 0, -1):
        own, level = _low(numbers[left], k + 1), levels[k - 1]
        place = level.symbol(own)
        hit = place >= 0
        out[left[hit]] += level.bits[place[hit]]
        left = left[~hit]
        place = level.context(own[~hit] >> np.uint64(8))
        seen = place >= 0
        out[left[seen]] += level.escape[place[seen]]
    out[left] += alone[_low(numbers[left], 1).astype(np.int64)]
    return out


def _joint(numbers: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct numbers of all languages, sorted, and their counts by language."""
    every = np.unique(np.concatenate(numbers))
    out = np.zeros((len(every), len(numbers)))
    for k, (x, n) in enumerate(zip(numbers, counts, strict=True)):
        np.add.at(out[:, k], np.searchsorted(every, x), n)
    return every, out


def _level(alone: np.ndarray, levels: list[Level], numbers: np.ndarray, count: np.ndarray) -> Level:
    """The next order. numbers: contexts with symbols, sorted; count: of each of them, by language."""
    context = numbers >> np.uint64(8)
    first = np.flatnonzero(np.concatenate([[True], context[1:] != context[:-1]])) if len(context) else np.zeros(0, int)
    times = np.add.reduceat(count.sum(1), first) if len(first) else np.zeros(0)
    often = np.argsort(-times, kind="stable")[: max(1, CELLS // count.shape[1])]
    held = np.zeros(len(first), bool)
    held[often[times[often] >= LEAST]] = True
    of = np.repeat(held, np.diff(np.append(first, len(context))))
    numbers, count, context = numbers[of], count[of], context[of]
    if not len(numbers):
        none = np.zeros((0, count.shape[1]))
        return Level(Places(numbers), none, Places(numbers), none)
    first = np.flatnonzero(np.concatenate([[True], context[1:] != context[:-1]]))
    group = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(context))))
    shorter = _costs(alone, levels, _low(numbers, len(levels) + 1))
    total, kinds = np.add.reduceat(count, first), np.add.reduceat((count > 0).astype(float), first)
    spread = np.where(kinds < 256, kinds, 0)  # with all bytes seen nothing escapes
    unseen = np.maximum(1 - np.add.reduceat(np.where(count > 0, np.exp2(-shorter), 0), first), 1e-12)
    escape = np.where(spread > 0, np.log2(unseen) - np.log2(np.maximum(spread, 1) / np.maximum(total + spread, 1)), 0)
    seen = -np.log2(np.maximum(count, 1) / np.maximum((total + spread)[group], 1))
    return Level(Places(numbers), np.where(count > 0, seen, shorter + escape[group]), Places(context[first]), escape)


def fit(samples: dict[str, list[bytes]]) -> Model:
    """samples: by language, its texts."""
    languages = sorted(samples)
    numbers, counts = [], []
    for x in languages:
        cuts = np.concatenate([[0], np.cumsum([len(t) for t in samples[x]])]).astype(np.int64)
        pieces = [np.unique(p[0], return_counts=True) for p in _pieces(np.frombuffer(b"".join(samples[x]), np.uint8), cuts)]
        numbers.append(np.concatenate([np.zeros(0, np.uint64), *(p[0] for p in pieces)]))
        counts.append(np.concatenate([np.zeros(0), *(p[1] for p in pieces)]))
    every, count = _joint(numbers, counts)
    tables = [(every, count)]
    for k in range(ORDER, 0, -1):  # each order's table from the next longer one's
        shorter, place = np.unique(_low(tables[0][0], k), return_inverse=True)
        count = np.stack([np.bincount(place, column, len(shorter)) for column in tables[0][1].T], axis=1)
        tables.insert(0, (shorter, count))
    alone = np.zeros((256, len(languages)))
    alone[tables[0][0].astype(np.int64)] = tables[0][1]
    total, kinds = alone.sum(0), np.count_nonzero(alone, axis=0)
    spread = np.where(kinds < 256, kinds, 0)
    escaped = np.where(total > 0, spread / np.maximum(total + spread, 1) / np.maximum(256 - kinds, 1), 1 / 256)
    alone = -np.log2(np.where(alone > 0, alone / np.maximum(total + spread, 1), np.maximum(escaped, 1e-12)))
    levels: list[Level] = []
    for numbers_, count in tables[1:]:
        levels.append(_level(alone, levels, numbers_, count))
    for level in levels:
        level.bits, level.escape = level.bits.astype(np.float32), level.escape.astype(np.float32)
    return Model(languages, alone.astype(np.float32), levels)


def code_lengths(model: Model, data: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Bits of each text in each language. cuts: the first text's start, which is 0, and each text's end."""
    out = np.zeros((len(cuts) - 1, len(model.languages)))
    for numbers, first, sizes in _pieces(data, cuts):
        own = np.flatnonzero(sizes)
        starts = (np.cumsum(sizes) - sizes)[own]
        out[first + own] += np.add.reduceat(_costs(model.alone, model.levels, numbers), starts, axis=0, dtype=np.float64)
    return out


def _has_letter(data: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    count = np.concatenate([[0], np.cumsum(_LETTER[data])])
    out = count[cuts[1:]] > count[cuts[:-1]]
    for k in np.flatnonzero(~out & (np.diff(cuts) > 0)):
        out[k] = any(c.isalpha() for c in data[cuts[k] : cuts[k + 1]].tobytes().decode("utf-8", "replace"))
    return out


def _score(model, at_text: int, first: int):
    """Rows of id, text and what is kept; the text may be one of the kept columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for batch in batches:
            data, offsets = text_buffers(batch.column(at_text))
            for at, to in chunks(offsets):
                part, cuts = data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
                known = _has_letter(part, cuts) & bool(m.languages)
                pred, score = np.full(to - at, UNDETERMINED, object), np.zeros(to - at)
                if known.any():
                    bits = code_lengths(m, part, cuts)[known]
                    best = bits.argmin(1)
                    pred[known] = np.array(m.languages, object)[best]
                    score[known] = 1 / np.exp2(-(bits - bits.min(1, keepdims=True))).sum(1)
                kept = batch.slice(at, to - at).columns[first:]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, to - at), pa.array(pred, pa.string()), pa.array(score), *kept], names=[*NAMES, *batch.schema.names[first:]])

    return run


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", folds: int = 5, most: int = 600) -> Model:
    """Fits on rows of folds other than 0 whose language and text aren't null: a sample of about most texts a
    language, told by a hash of the id; texts are taken whole. No labelled row: a model of no language."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    rows = rows.filter((fold("id", folds) != 0) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    got = bounded_sample(rows, "lang", "id", most).select("lang", "text").toPandas()
    samples = {str(x): [t.encode() for t in g["text"]] for x, g in got.groupby("lang")} if len(got) else {}
    return fit(samples) if samples else Model([], np.zeros((256, 0), np.float32), [])


def detect_language(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: list[str] = ()) -> DataFrame:
    """Per row of docs: doc_id, lang_pred, score, and the columns in keep, whose names are prefixed by 'kept_'.

    lang_pred is the language with the shortest code for the whole text (ties: the first by name), score its
    posterior probability when all languages are equally likely. A text that is null, empty or has no
    letter is 'und' with score 0, as is every text if no language was learnt. Repeated rows repeat their
    result; an empty table gives an empty one.
    """
    narrow_batches(docs.sparkSession)
    kept = [F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)]  # numbered on the way: Arrow maps know no dotted names
    own = [] if text_col in keep else [F.col(text_col).cast("string").alias("text")]  # a text travels once
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), *own, *kept)
    sent = docs.sparkSession.sparkContext.broadcast(model)  # CELLS numbers of contexts an order at most, and their symbols
    more = "".join(f", `{f.name}` {f.dataType.simpleString()}" for f in rows.schema[1 + len(own) :])
    out = rows.mapInArrow(tidy(_score(sent, 1 if own else 1 + list(keep).index(text_col), 1 + len(own))), f"doc_id long, lang_pred string, score double{more}")
    return out.toDF(*NAMES, *(f"kept_{c}" for c in keep))


def op2_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = detect_language(docs, train(docs))
    return out.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "lang_pred", "score")
