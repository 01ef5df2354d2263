"""MinHash near-dedup: a Chosen-Path set similarity join.

Every document has a signature of minwise tokens of its shingle set. Independent trees branch the
documents: a node's children are told by the values of selected minwise tokens, so that two sets of
similarity J go down the same branch with probability J. The first two levels of each tree are one
step. Small nodes are compared exhaustively; a large node branches on, by 1.25 tokens a level on
average (1/J at J = 0.8), so that a pair keeps a chance to stay together at any depth while the
number of leaves of a document grows slowly. Trees are independent and repeat: a pair at J = 0.85
is missed by all twelve of them in 2 cases of 10 ** 7 where nodes are small at once, and in 1 of 10 ** 4
three levels deeper; for 0.8 there are sixteen, which miss 8 of 10 ** 8 and 2 of 10 ** 4. A node that no token splits any more is compared exhaustively in tiles, so no
task ever holds a node without bound.

A node's comparison tells candidates by their signatures, with a margin under the threshold. Links
are then confirmed exactly on full shingle sets, inside clusters of candidates: a cluster of many
tiles first within each tile, then between the representatives of what hangs together, and only where
parts are left over between all its tiles. Documents with the same shingle set are represented by the
one with the smallest id.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .scratch import Scratch, narrow_batches, tidy
from .shingles import distinct, mix, shingle_hashes, text_words
from .sieve import sifted

#: Length of a signature; the first two tokens of each tree are its own, the rest serve deeper levels.
K, DEEPER = 64, 16
#: Most documents of a node that is compared as it is, and of a tile of a larger one.
NODE, TILE, TILE_SHINGLES = 2048, 512, 1 << 21
_rng = np.random.default_rng(85)
_A = _rng.integers(0, 1 << 31, K, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_B = _rng.integers(0, 1 << 32, K, dtype=np.uint32)


def trees(percent: int) -> int:
    """Independent trees: more for pairs that part more easily."""
    return 12 if percent >= 85 else 16


def least_matches(percent: int) -> int:
    """Matching tokens of a signature that make a candidate: 4.5 standard deviations under the mean at the threshold."""
    return int(K * percent / 100 - 4.5 * (K * percent / 100 * (1 - percent / 100)) ** 0.5)


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """The K minwise tokens of each set that isn't empty."""
    sizes = np.array([len(x) for x in sets])
    starts = np.cumsum(sizes) - sizes
    tokens = (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32)
    out = np.empty((len(sets), K), np.uint32)
    for k in range(K):
        out[:, k] = np.minimum.reduceat(tokens * _A[k] + _B[k], starts)
    return out


def _sign(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for at, to, words, cuts in text_words(texts):
                sets = [distinct(shingle_hashes(words[a:b], size)) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
                full = [x for x in sets if len(x)]
                tokens = iter(signatures(full)) if full else iter(())
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(at, to - at),
                        pa.array([len(x) for x in sets], pa.int64()),
                        pa.array([blake2b(x.tobytes(), digest_size=16).digest() for x in sets], pa.binary()),
                        pa.array([next(tokens).tobytes() if len(x) else None for x in sets], pa.binary()),
                    ],
                    names=["id", "n", "digest", "signature"],
                )

    return run


def _matrix(column: pa.Array, kind) -> np.ndarray:
    column = column.cast(pa.large_binary())
    ends = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[ends[0] : ends[-1]].view(kind).reshape(len(column), -1)


def _fixed(rows: np.ndarray) -> pa.Array:
    rows = np.ascontiguousarray(rows, np.uint8)
    offsets = np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(offsets), pa.py_buffer(rows)])


def _roots(trees: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each document's node in each tree, two levels below the root, and its tokens of 8 bits each."""
        for batch in batches:
            if not len(batch):
                continue
            tokens = _matrix(batch.column(1), np.uint32)
            for tree in range(trees):
                pair = tokens[:, 2 * tree].astype(np.uint64) << np.uint64(32) | tokens[:, 2 * tree + 1]
                node = mix(pair ^ mix(np.full(1, tree + 1, np.uint64)))
                yield pa.RecordBatch.from_arrays([pa.array(node.view(np.int64)), batch.column(0), _fixed(tokens.astype(np.uint8))], names=["node", "id", "tokens"])

    return run


def _branch(level: int, trees: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A child of each node for each document, by a token that the node's name selects; a second one for a quarter of the nodes."""
        for batch in batches:
            for twig in range(2):
                if twig and len(batch):
                    more = mix(batch.column(0).to_numpy().view(np.uint64) + np.uint64(1000 + level)) % np.uint64(4) == 0
                    batch = batch.filter(pa.array(more))
                if not len(batch):
                    break
                node, tokens = batch.column(0).to_numpy().view(np.uint64), _matrix(batch.column(2), np.uint8)
                chosen = mix(node + np.uint64(2 * level + twig + 1))
                at = 2 * trees + (chosen % np.uint64(K - 2 * trees)).astype(np.int64)
                child = mix(chosen ^ mix(tokens[np.arange(len(at)), at].astype(np.uint64) + np.uint64(1)))
                yield pa.RecordBatch.from_arrays([pa.array(child.view(np.int64)), batch.column(1), batch.column(2)], names=["node", "id", "tokens"])

    return run


def _groups(batches: Iterator[pa.RecordBatch], key: int = 0) -> Iterator[pa.Table]:
    """Batches sorted by the column key, dealt anew so that no group is cut."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not len(batch):
            continue
        keys = batch.column(key).to_numpy()
        if held and keys[0] != held[-1].column(key)[-1].as_py():
            yield pa.Table.from_batches(held)
            held = []
        last = int(np.searchsorted(keys, keys[-1]))
        if last:
            yield pa.Table.from_batches([*held, batch.slice(0, last)])
            held = []
        held.append(batch.slice(last))
    if held:
        yield pa.Table.from_batches(held)


def _candidates(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Pairs that connect what a node's exhaustive comparison holds alike; each row is compared with each later row of its node."""
        for table in _groups(batches):
            batch = table.combine_chunks().to_batches()[0]
            node, ids, tokens = batch.column(0).to_numpy(), batch.column(1).to_numpy(), _matrix(batch.column(2), np.uint8)
            label, rows, step = np.arange(len(node)), np.arange(len(node) - 1), 1
            while len(rows := rows[rows + step < len(node)]) and len(rows := rows[node[rows] == node[rows + step]]):
                open_ = rows[label[rows] != label[rows + step]]
                for k in range(0, len(open_), 16384):
                    a = open_[k : k + 16384]
                    a = a[np.count_nonzero(tokens[a] == tokens[a + step], axis=1) >= least]
                    if len(a):
                        _join(label, a, a + step)
                step += 1
            away = np.flatnonzero(label != np.arange(len(label)))
            if len(away):
                yield pa.RecordBatch.from_arrays([pa.array(ids[away]), pa.array(ids[label[away]])], names=["a", "b"])

    return run


def _join(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Merges the groups of a and b; label has a root for each row, and roots have themselves."""
    x, y = label[a], label[b]
    while len(x):
        low, high = np.minimum(x, y), np.maximum(x, y)
        np.minimum.at(label, high, low)
        while (after := label[label]).tobytes() != label.tobytes():
            label[:] = after
        x, y = label[x], label[y]
        x, y = x[x != y], y[x != y]


def _sets(size: int, whole: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Full sets of the documents of candidate clusters, once for their own tile or, if whole, for each pair of tiles. Columns: id,
        text, digest, cluster, tiles."""
        for batch in batches:
            for at, to, words, cuts in text_words(batch.column(1)):
                out = []
                for row, a, b in zip(range(at, to), cuts[:-1], cuts[1:], strict=True):
                    tokens = distinct(shingle_hashes(words[a:b], size)).tobytes()
                    i, _, digest, cluster, tiles = (c[row].as_py() if k != 1 else None for k, c in enumerate(batch.columns))
                    if blake2b(tokens, digest_size=16).digest() != digest:
                        continue  # another text of a repeated id
                    own = int(mix(np.array([i], np.int64).view(np.uint64))[0] % np.uint64(tiles))
                    for other in range(tiles) if whole else (own,):
                        if len(out) == 256:
                            yield _rows(out)
                            out = []
                        low, high = min(own, other), max(own, other)
                        key = mix(mix(np.array([cluster], np.int64).view(np.uint64)) + np.uint64(low * 1_000_003 + high))
                        out.append((int(key.view(np.int64)[0]), i, tokens))
                if out:
                    yield _rows(out)

    def _rows(out: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["tile", "id", "tokens"])

    return run


def _common(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections."""
    tokens, sizes = np.concatenate(sets), [len(x) for x in sets]
    order = np.argsort(tokens, kind="stable")
    tokens, row = tokens[order], np.repeat(np.arange(len(sets)), sizes)[order]
    new = np.concatenate([[True], tokens[1:] != tokens[:-1]])
    column = np.cumsum(new) - 1
    shared = np.bincount(column)[column] > 1
    row, column = row[shared], column[shared]
    out = np.zeros((len(sets), len(sets)), np.float32)
    if not len(row):
        return out
    column = np.cumsum(np.concatenate([[0], column[1:] != column[:-1]]))
    width = 4096
    cuts = np.searchsorted(column, np.arange(0, column[-1] + 1 + width, width))
    for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
        part = np.zeros((len(sets), width), np.float32)
        part[row[a:b], column[a:b] - k * width] = 1
        out += part @ part.T
    return out


def _links(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Pairs that connect each component of the confirmed links of a pair of tiles."""
        for table in _groups(batches):
            tile = table.column(0).to_numpy()
            cuts = np.flatnonzero(np.concatenate([[True], tile[1:] != tile[:-1], [True]]))
            out: list[tuple[int, int]] = []
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if b - a < 2:
                    continue
                part = table.slice(a, b - a)
                ids = part.column(1).to_pylist()
                sets = [np.frombuffer(x, np.uint64) for x in part.column(2).to_pylist()]
                size = np.array([len(x) for x in sets])
                if len(ids) > 2:
                    common = _common(sets)
                else:
                    both = np.sort(np.concatenate(sets))
                    common = np.full((2, 2), np.count_nonzero(both[1:] == both[:-1]))
                linked = 100 * common >= percent * (size[:, None] + size[None, :] - common)
                group = np.arange(len(ids))
                _join(group, *np.nonzero(np.triu(linked, 1)))
                out += [(ids[i], ids[j]) for i, j in enumerate(group.tolist()) if i != j]
            if out:
                x = np.array(out, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(x[:, 0]), pa.array(x[:, 1])], names=["a", "b"])

    return run


def _tiled(member: DataFrame) -> DataFrame:
    """With the number of tiles that a cluster's members are dealt over: by how many they are and how many shingles they have."""
    tiles = member.groupBy("cluster").agg(F.greatest(F.ceil(F.count("*") / TILE), F.ceil(F.sum("n") / TILE_SHINGLES)).alias("tiles"))
    return member.join(tiles, "cluster").select("id", "cluster", "digest", "n", "tiles")


def _parts(member: DataFrame, links: DataFrame) -> DataFrame:
    """With the member of its tile that a member hangs together with: links of own tiles have one row for each that isn't the first of its part."""
    return member.join(links.select(F.col("a").alias("id"), F.col("b").alias("first")), "id", "left").withColumn("part", F.coalesce("first", "id")).drop("first")


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3, percent: int = 85) -> DataFrame:
    """Per row of docs: doc_id, n_shingles, component_id, kept.

    Two documents are linked when 100 * |A & B| >= percent * |A | B| for their sets of shingles of
    size words (fewer words: one shingle of all of them). component_id is the smallest id that can
    be reached over links. An empty or null text, or one without words, has no shingles, links
    to nothing and is its own component. An id is one document: rows that repeat an id with the same
    text have the same result, and with other texts they join what those texts link to. A row with a
    null id is linked with nothing and has a null component and kept = true. An empty table gives an
    empty result. Columns other than the two named ones are not read.

    percent may not be under 80: the trees' number and the candidates' margin are made for that.
    """
    if percent < 80:
        raise ValueError("percent must be 80 or more")
    narrow_batches(docs.sparkSession)
    spark = docs.sparkSession
    scratch = Scratch(spark)
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    signed = scratch.cut(docs.mapInArrow(tidy(_sign(size)), "id long, n long, digest binary, signature binary"))
    full = signed.filter("n > 0 and id is not null")
    classes = scratch.cut(full.groupBy("digest").agg(F.min("id").alias("id"), F.min("signature").alias("signature"), F.min("n").alias("n")))

    # The trees, level by level
    form = "node long, id long, tokens binary"
    nodes = classes.select("id", "signature").mapInArrow(tidy(_roots(trees(percent))), form)
    leaves, parts = [], "node long, id long, tokens binary, size long"
    for level in range(DEEPER + 1):
        sizes = scratch.cut(nodes.groupBy("node").agg(F.count("*").alias("size")).filter("size > 1"))
        # only rows of nodes that may have others go to the join, which is one of shuffled rows at any size
        held = scratch.cut(sifted(nodes, sizes, "node").join(sizes.hint("merge"), "node").select("node", "id", "tokens", "size"))
        leaves.append(held.filter(F.col("size") <= NODE).select("node", "id", "tokens"))
        large = held.filter(F.col("size") > NODE)
        if large.isEmpty():
            break
        if level < DEEPER:
            nodes = large.select("node", "id", "tokens").mapInArrow(tidy(_branch(level, trees(percent))), form)
        else:  # exhaustively, each pair of tiles by itself
            tiles = F.ceil(F.col("size") / NODE)
            own = F.pmod(F.xxhash64("id"), tiles)
            leaves.append(
                large.select("node", "id", "tokens", own.alias("own"), F.explode(F.sequence(F.lit(0), tiles - 1)).alias("other")).select(
                    F.xxhash64("node", F.least("own", "other"), F.greatest("own", "other")).alias("node"), "id", "tokens"
                )
            )
    compared = leaves[0]
    for more in leaves[1:]:
        compared = compared.unionByName(more)
    pairs = compared.repartition("node").sortWithinPartitions("node").mapInArrow(tidy(_candidates(least_matches(percent))), "a long, b long")
    clusters = scratch.cut(components(pairs, scratch))

    # Links confirmed on full sets
    member = scratch.cut(clusters.join(classes.select("id", "digest", "n"), "id").select("id", F.col("label").alias("cluster"), "digest", "n"))
    member = scratch.cut(_tiled(member))

    def confirmed(rows: DataFrame, whole: bool = False) -> DataFrame:
        # only texts that may be members' go to the join
        texts = sifted(docs, rows, "id").join(rows.select("id", "digest", "cluster", "tiles").hint("merge"), "id").select("id", "text", "digest", "cluster", "tiles")
        sets = texts.mapInArrow(tidy(_sets(size, whole)), "tile long, id long, tokens binary")
        return scratch.cut(sets.repartition("tile").sortWithinPartitions("tile").mapInArrow(tidy(_links(percent)), "a long, b long"))

    links = confirmed(member)
    large = member.filter("tiles > 1")
    if not large.isEmpty():
        firsts = scratch.cut(_parts(large, links).filter("id = part"))
        several = firsts.groupBy("cluster").agg(F.count("*").alias("parts")).filter("parts > 1").select("cluster")
        firsts = scratch.cut(_tiled(firsts.join(several, "cluster").select("id", "cluster", "digest", "n")))
        more = confirmed(firsts)
        parts = _parts(firsts, more).groupBy("cluster").agg(F.min("part").alias("low"), F.max("part").alias("high")).filter("low <> high")
        left = scratch.cut(large.join(parts.select("cluster"), "cluster").select(*large.columns))
        links = links.unionByName(more)
        if not left.isEmpty():
            links = links.unionByName(confirmed(left, whole=True))
    repeated = full.groupBy("id").agg(F.min("digest").alias("low"), F.max("digest").alias("high")).filter("low <> high").select("id")
    same = full.join(repeated, "id", "left_semi").join(classes.select("digest", F.col("id").alias("b")), "digest").select(F.col("id").alias("a"), "b")
    found = components(links.unionByName(same), scratch)

    of_class = classes.select("digest", F.col("id").alias("first")).join(found.select(F.col("id").alias("first"), "label"), "first", "left")
    of_class = of_class.select("digest", F.coalesce("label", "first").alias("label"))
    out = signed.select("id", "n", F.when((F.col("n") > 0) & F.col("id").isNotNull(), F.col("digest")).alias("digest")).join(of_class, "digest", "left")
    return out.select(
        F.col("id").alias("doc_id"),
        F.col("n").alias("n_shingles"),
        F.coalesce("label", "id").alias("component_id"),
        F.coalesce(F.coalesce("label", "id") == F.col("id"), F.lit(True)).alias("kept"),
    )


def op1_minhash_dedup(spark, sf_dir: str) -> DataFrame:
    return near_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
