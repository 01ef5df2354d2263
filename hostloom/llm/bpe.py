"""BPE encoding and decoding by prefix-sharing trie traversal.

Distinct words go into a trie; a depth-first walk carries, for each prefix, the last token of the
prefix's encoding. The encoding of a prefix is the encoding of a shorter prefix plus one token, and
that token is the one vocabulary entry ending here that is compatible with the last token before
it (the pair by itself encodes as just these two). So shared prefixes are encoded once, and a word's
encoding is read by following last tokens back to the root.

The vocabulary is a word-level BPE with an end-of-word mark: the trie's symbols are the byte
characters of a word, and a word ends in a symbol that carries the mark.
"""

from __future__ import annotations

import contextlib
import gc
import hashlib
import json
import re
import struct
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import give_back, narrow_batches
from .shingles import chunks, text_buffers

END = "</w>"
LATIN = "\u024f"
#: Chunks of text whose encodings a task keeps, and words that a worker keeps in each of two generations.
KEPT, WORDS = 100_000, 80_000


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_characters() -> list[str]:
    """The printable character that stands for each byte: itself if printable in Latin-1, else one from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, more = [""] * 256, 256
    for b in range(256):
        if b in printable:
            out[b] = chr(b)
        else:
            out[b], more = chr(more), more + 1
    return out


class Encoder:
    """The tokenizer of a vocabulary file, without truncation, padding or special tokens being added."""

    def __init__(self, path: str, special: bool = True):
        self.path, self.library, self.stand_ins = path, None, {}
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        if model["type"] != "BPE" or model.get("end_of_word_suffix") != END or model.get("ignore_merges") or spec.get("decoder"):
            raise ValueError("a BPE vocabulary with an end-of-word mark and no decoder is wanted")
        self.ids: dict[str, int] = model["vocab"]
        self.rank = {tuple(m.split(" ") if isinstance(m, str) else m): k for k, m in enumerate(model["merges"])}
        added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = {i: t for t, i in (self.ids | added).items()}
        #: Without special, their strings are ordinary text.
        self.special = added if special else {}
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        steps = spec["pre_tokenizer"]["pretokenizers"]
        pattern = steps[0]["pattern"]["Regex"]
        self.words = regex.compile(pattern)
        #: The same for lower-case ASCII, whose letters and numbers are these.
        self.ascii_words = re.compile(pattern.replace(r"\p{L}", "a-z").replace(r"\p{N}", "0-9").replace(r"\s", r" \t-\r")).findall
        self.bytes = byte_characters()
        #: By merged token: the rank of the merge that makes it, and its two sides.
        self.made = {a + b: (k, a, b) for (a, b), k in reversed(self.rank.items())}
        lengths: dict[str, set[int]] = {}
        self.doubles: set[str] = set()
        for token in self.ids:
            body, mark = (token[: -len(END)], END) if token.endswith(END) and token != END else (token, "")
            if self.reached(token):
                if len(body) > 2:
                    lengths.setdefault(body[-3:] + mark, set()).add(len(body))
                elif len(body) == 2:
                    self.doubles.add(token)
        #: By the last three symbols: lengths of the longer tokens that encode as themselves, longest first.
        self.lengths = {k: tuple(sorted(v, reverse=True)) for k, v in lengths.items()}
        self.of_byte = "".join(self.bytes)
        self.fits: dict[tuple[str, str], bool] = {}
        self.chunks: dict[str, tuple[bytes, str]] = {}
        self.known: dict[str, tuple[bytes, str]] = {}
        self.turn()

    def symbols(self, token: str) -> list[str]:
        body = token.removesuffix(END)
        out = list(body)
        if len(body) < len(token):
            out[-1] += END
        return out

    def merged(self, symbols: list[str]) -> list[str]:
        """Plain BPE: the pair of the lowest rank, leftmost first, until none is left."""
        rank = self.rank.get
        while len(symbols) > 1:
            ranks = [rank(pair, 1 << 60) for pair in zip(symbols, symbols[1:], strict=False)]
            best = min(ranks)
            if best == 1 << 60:
                break
            at = ranks.index(best)
            symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]
        return symbols

    def compatible(self, left: str, right: str) -> bool:
        """Whether the two, each encoding as itself, stay apart when they meet.

        Both are undone merge by merge, the later one first, down to the symbols at the border: at
        each stage the pair that meets there must not merge before what comes next is made.
        """
        pair = left, right
        found = self.fits.get(pair)
        if found is not None:
            return found
        rank, made = self.rank, self.made
        limit = 1 << 60
        a, b = left, right
        while True:
            if rank.get((a, b), 1 << 60) < limit:
                found = False
                break
            of_a, of_b = made.get(a), made.get(b)
            if of_a is None and of_b is None:
                found = True
                break
            # a pair at the border is the later one if ranks are equal: the leftmost of equals goes first
            if of_b is None or of_a is not None and of_a[0] > of_b[0]:
                limit, a = of_a[0], of_a[2]
            else:
                limit, b = of_b[0] + 1, of_b[1]
        self.fits[pair] = found
        return found

    def last_token(self, word: str, n: int, mark: str, last: list[str]) -> str:
        """The last token of the first n symbols of word, given those of all shorter prefixes (last[0] is the root's)."""
        fits = self.fits
        for length in self.lengths.get(word[max(n - 3, 0) : n] + mark, ()):
            if length <= n:
                token = word[n - length : n] + mark
                if token in self.ids:
                    if length == n:
                        return token
                    left = last[n - length]
                    fit = fits.get((left, token))
                    if fit or fit is None and self.compatible(left, token):
                        return token
        if n > 1:
            token = word[n - 2 : n] + mark
            if token in self.doubles and (n == 2 or self.compatible(last[n - 2], token)):
                return token
        return word[n - 1 : n] + mark

    def reached(self, token: str) -> bool:
        """Whether the token encodes as itself."""
        return len(self.merged(self.symbols(token))) == 1

    def encode_words(self, words: set[str]) -> dict[str, list[str]]:
        """Tokens of each word. Sorted order is the trie's depth-first order: a common prefix is walked once."""
        out, path, last = {}, "", [""]
        for word in sorted(words):
            keep, most = 0, min(len(path), len(word))
            while keep < most and path[keep] == word[keep]:
                keep += 1
            del last[keep + 1 :]
            for n in range(keep + 1, len(word)):
                last.append(self.last_token(word, n, "", last))
            path = word[:-1]
            del last[len(path) + 1 :]
            token = self.last_token(word, len(word), END, last)
            tokens, at = [token], len(word) + len(END) - len(token)
            while at:
                token = last[at]
                tokens.append(token)
                at -= len(token)
            out[word] = tokens[::-1]
        return out

    def pieces(self, chunk: str) -> list[str]:
        """The words of a chunk as byte characters."""
        if chunk.isascii():
            if chunk.isalpha():
                return [chunk.lower()]
            found = self.ascii_words(chunk.lower())
            return found if chunk.isprintable() else [w.translate(self.of_byte) for w in found]
        if not unicodedata.is_normalized("NFC", chunk):
            chunk = unicodedata.normalize("NFC", chunk)
        # a character at a time where the rule for a final sigma would set in
        lower = "".join(c.lower() for c in chunk) if "\u03a3" in chunk else chunk.lower()
        found = self.words.findall(lower)
        if max(lower) > LATIN and any(c > LATIN and unicodedata.category(c) == "Cn" for c in lower):
            self.ask()
            lower = self.library.normalizer.normalize_str(chunk)  # new letters may have a case
            seen = "".join(self.stand_in(c) if unicodedata.category(c) == "Cn" else c for c in lower)
            found = [lower[m.start() : m.end()] for m in self.words.finditer(seen)]
        return [w.encode().decode("latin-1").translate(self.of_byte) for w in found]

    def ask(self) -> None:
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_file(self.path)

    def stand_in(self, c: str) -> str:
        """A character of the kind that the tokenizers library takes c for; the pattern library knows a newer Unicode, so
        the two differ on characters that are new or not assigned. Asked once a character."""
        if c not in self.stand_ins:
            pieces = [len(self.library.pre_tokenizer.pre_tokenize_str(x + c)) for x in "a:"]
            self.stand_ins[c] = {(1, 2): "\u0250", (2, 2): "\u00b2"}.get(tuple(pieces), "\u0378")
        return self.stand_ins[c]

    def learn(self, chunks: set[str]) -> None:
        """Encodes chunks of text that the cache doesn't have."""
        parts: list[tuple[str, list[str]]] = []
        new: set[str] = set()
        pieces, special = self.pieces, self.special
        for chunk in chunks:
            if special and "<|" in chunk:
                own: list[str] = []
                for piece in self.split_special.split(chunk):
                    if piece in special:
                        own.append(piece)
                    elif piece:
                        own += pieces(piece)
            else:
                own = pieces(chunk)
            parts.append((chunk, own))
            new.update(own)
        known, ids = self.known, self.ids
        new.difference_update(known)
        again = new.intersection(self.older)
        known.update((w, self.older[w]) for w in again)
        for word, tokens in self.encode_words(new - again).items():
            tokens = [t for t in tokens if t in ids]
            known[word] = struct.pack(f"<{len(tokens)}I", *[ids[t] for t in tokens]), " ".join(tokens)
        for chunk, own in parts:
            if len(own) == 1:
                self.chunks[chunk] = known[own[0]]
            else:
                found = [known[w] for w in own]
                self.chunks[chunk] = b"".join([f[0] for f in found]), " ".join([f[1] for f in found if f[0]])

    def turn(self) -> None:
        """A new generation of the words: what the last one had is kept as long as it is asked for again."""
        # a word is in byte characters, so the text of a special token can't be one unless it has these very letters
        self.older, self.known = self.known, {t: (i.to_bytes(4, "little"), t) for t, i in self.special.items()}
        if len(self.fits) > 2 * WORDS:
            self.fits = {}

    def rest(self) -> None:
        """Lets go of what a task doesn't leave to the next one of its worker."""
        self.chunks, self.older = {}, {}
        give_back()

    def encode(self, texts: list[str]) -> Iterator[tuple[bytes, str]]:
        """Of each text the ids, as little-endian unsigned 32-bit integers, and what they decode to."""
        split = [t.replace("\n", " ").replace("\t", " ").split(" ") for t in texts]
        if len(self.chunks) > KEPT:
            self.chunks = {}
        if len(self.known) > WORDS:
            self.turn()
        new: set[str] = set()
        for chunks in split:
            new.update(chunks)
        new.difference_update(self.chunks)
        self.learn(new)
        get = self.chunks.__getitem__
        for chunks in split:
            found = list(map(get, chunks))
            yield b"".join([f[0] for f in found]), " ".join([f[1] for f in found if f[0]])


@lru_cache(maxsize=2)
def encoder(path: str, special: bool = True) -> Encoder:
    return Encoder(path, special)


@contextlib.contextmanager
def uncollected() -> Iterator[None]:
    """Caches hold millions of small objects without cycles; looking for cycles among them again and again costs a sixth of the time."""
    gc.disable()
    try:
        yield
    finally:
        gc.enable()


def decode(ids: list[int], path: str) -> str:
    """The text of ids; the vocabulary has no decoder, so tokens are joined by spaces."""
    known = encoder(path).tokens
    return " ".join(known[i] for i in ids if i in known)


def _decoded(digests: bool, decoded: bool | str) -> list[str]:
    """The name of the column that tells what ids decode to, if there is one."""
    return ["decoded_sha256"] if digests or decoded == "digest" else ["decoded"] if decoded else []


def _encode(name: str, digests: bool, decoded: bool | str = True):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(vocabulary_path(name))
        with uncollected():
            for batch in batches:
                for at, to in chunks(text_buffers(batch.column(0))[1], 1 << 22):
                    part = batch.slice(at, to - at)
                    rows = list(own.encode([t or "" for t in part.column(0).to_pylist()]))
                    raw = [r[0] for r in rows]
                    columns = [pa.array([len(r) // 4 for r in raw], pa.int64())]
                    columns.append(pa.array([hashlib.sha256(r).hexdigest() for r in raw], pa.string()) if digests else pa.array(raw, pa.binary()))
                    told = _decoded(digests, decoded)
                    columns += [pa.array([hashlib.sha256(r[1].encode()).hexdigest() if c == "decoded_sha256" else r[1] for r in rows], pa.string()) for c in told]
                    names = ["ids_sha256" if digests else "ids", *told]
                    yield pa.RecordBatch.from_arrays([*columns, *part.columns[1:]], names=["n_tokens", *names, *part.schema.names[1:]])
        own.rest()

    return run


def bpe_encode(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None, vocabulary: str = "word_bpe_49k.json", digests: bool = False, decoded: bool | str = True) -> DataFrame:
    """Per row of docs: n_tokens, ids (binary, little-endian unsigned 32-bit), decoded, and the columns in keep
    (null: all). With digests, ids_sha256 and decoded_sha256 instead of ids and decoded; without decoded, the ids alone; with
    decoded="digest", ids and decoded_sha256.

    Whole texts are encoded; null is an empty text, which has no tokens and decodes to ''. Strings of
    special tokens in a text become those tokens. Rows stand for themselves, so repeated rows repeat
    their result and an empty table gives an empty one. A kept column that has the name of a result
    (case ignored) gets underscores before its own, as many as make it another.
    """
    narrow_batches(docs.sparkSession)
    keep = docs.columns if keep is None else keep
    names = ["n_tokens", "ids_sha256" if digests else "ids", *_decoded(digests, decoded)]
    taken, own = {n.lower() for n in names} | {c.lower() for c in keep if c.lower() not in names}, []
    for c in keep:
        name = c
        if c.lower() in names:
            while name.lower() in taken:
                name = "_" + name
            taken.add(name.lower())
        own.append(name)
    # numbered on the way: Arrow maps know no dotted names
    rows = docs.select(F.col(text_col).cast("string").alias("\x00text"), *(F.col(f"`{c}`").alias(f"k{k}") for k, c in enumerate(keep)))
    kinds = ["long", "string" if digests else "binary", "string"][: len(names)]
    schema = ", ".join([*(f"{n} {k}" for n, k in zip(names, kinds, strict=True)), *(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema[1:])])
    return rows.mapInArrow(_encode(vocabulary, digests, decoded), schema).toDF(*names, *own)


def op5_bpe(spark, sf_dir: str) -> DataFrame:
    out = bpe_encode(spark.read.parquet(f"{sf_dir}/documents.parquet"), keep=["doc_id"], digests=True)
    return out.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
