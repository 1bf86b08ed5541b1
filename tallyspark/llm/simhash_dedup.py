"""SimHash near-dedup by a binary-trie self-join.

A document's fingerprint has bit b set if more than half of its shingles' hashes
have it set. Two fingerprints are linked if they differ in at most ``BUDGET``
bits. Distinct fingerprints only are joined, so that copies cost nothing.

The join descends a binary trie with itself: a pair of nodes carries the number
of bits in which its two prefixes differ, and a pair over the budget is pruned
with all below it. To deal the work out, the 64 bits are cut into four blocks of
16; two fingerprints within two bits agree on at least two whole blocks, so each
fingerprint goes to its six (pair of blocks, value) groups, and the trie of a
group has the other 32 bits. A fingerprint has at most 1 + 32 + 496 others in
its budget there, which bounds the node pairs by the group's size. A group of
over ``HOT_GROUP`` fingerprints is dealt out further by the trie's node pairs at
depth ``HOT_DEPTH``.

Each task reports its links as one row for each fingerprint and group (to the
smallest fingerprint that it reaches in the group); connected components of
those rows are the classes.

``keep_representatives`` links texts whose sets of five-word shingles have a Jaccard
similarity of ``SIMILARITY`` or more. At 0.8 two in thirteen bits differ, far more
than a join by whole blocks of a 64-bit fingerprint can bridge. So it takes a longer
sketch: more signs of projections of the same set, in ``bands`` of bits. Texts that
agree in a band meet in a group; there the trie of 64 further bits is joined with
itself within ``LOOSE`` bits, and ``CHECKED`` bits in all must be near. A text with few
partners in a group has them all as candidates; in dense families, where hardly
any pair is far below the similarity asked for, the whole sketches (about a thousand bits)
of the group's texts are brought together and each has its ``NEAREST`` ones. Candidates
are compared exactly in rounds, nearest first, until none is left between two classes;
components of the confirmed links are the classes so far. The groups in which a text had more
partners than are listed, or was left out, are then gone through once more (``rest_links``):
texts of different classes that are near by 128 bits make up families, whose texts are
compared exactly with all others of their family, in pairs of blocks. So no partner in a band goes uncompared. The number of bits in a band grows
with the logarithm of the number of texts, so that groups stay small, and the number of
bands is what catches ``RECALL`` of the pairs at the threshold itself; nearer ones are
caught more surely. Groups of over ``CROWD`` texts are dealt out at random first; there
each text surely similar to an earlier one (``CERTAIN``) is paired with that and left out
of this band's group at first. The texts of a dense family that share a band are compared by
sketches in one task, in blocks: time, not memory, grows with the square of their number, as does
what is shuffled for families of many blocks that aren't one class yet.

Edge cases: null, empty and blank texts have fingerprint zero and are linked like
any other; repeated rows are all returned; a null doc_id never names a class
unless no other id is there; an empty table gives an empty result. When rows are
kept, texts with the same shingles are one class and so are texts without words; of
rows that are the same in all columns one stays; columns may have any name and type.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import components, own, partitions, row_hash, size_marks, spread_join, stored

BUDGET = 2
SHINGLE = 3
SEED = 42
BLOCK = 16
BLOCK_PAIRS = tuple(combinations(range(4), 2))
HOT_GROUP = 4096
HOT_DEPTH = 8
SLAB_ROWS = 1 << 18
#: Of texts that are kept or not by similarity.
WORDS = 5
SIMILARITY = 0.8
RECALL = 0.99
CROWD = 512
LOOSE, CHECKED = 24, 36  # bits of 64 and of 128 that may differ: of pairs at 0.8 fewer than one in a thousand has more
CERTAIN = 7  # bits of 128: of pairs below 0.8 fewer than one in a thousand has so few
#: Partners in a group up to which all are listed; of rows with more, the nearest by the whole sketch.
FEW, NEAREST = 16, 8
#: Rows of a group up to which the trie is joined; larger ones go by whole sketches, in blocks.
DENSE = 4096
#: Standard deviations of a sketch's distance at the similarity asked for that are let through.
SPREAD = 1.65
#: Shingles of texts that a task keeps while comparing.
SETS = 1 << 21
#: Partners that a text is compared with in each round; 0: all.
ROUNDS = (2, 8, 0)
#: Partners that one copy of a text is compared with.
PARTNERS = 64
FRONTIER = 1 << 20
#: Texts of a block in the exact comparison of families, and bytes of text.
FAMILY_ROWS, FAMILY_BYTES = 1024, 8 << 20
#: Texts of two blocks with a shingle up to which its pairs are listed, and columns of a product of matrices for the other shingles.
SCARCE, COLUMNS = 32, 2048
_UPPER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_PIECE = 1 << 16


def shingle_hashes(text: bytes | None, shingle: int = SHINGLE) -> Iterator[np.ndarray]:
    """Hashes of the shingles of one UTF-8 text, repeats included, in pieces of bounded size."""
    words = (text or b"").translate(_UPPER).split()
    if not words:
        return
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    # ends[i]: where word i ends in joined; a shingle is a slice of it
    ends = (np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1).tolist()
    starts = [0, *(e + 1 for e in ends[:-shingle])]
    ends = ends[min(shingle, len(words)) - 1 :]
    for k in range(0, len(ends), _PIECE):
        yield np.array([digest(joined[s:e], SEED) for s, e in zip(starts[k : k + _PIECE], ends[k : k + _PIECE], strict=True)], np.uint64)


def text_fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """Fingerprint of one UTF-8 text, as an unsigned 64-bit number."""
    ones, n = np.zeros(64, np.int64), 0
    for part in shingle_hashes(text, shingle):
        ones += np.unpackbits(part.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
        n += len(part)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """Rows ``(doc_id, fp)``, fp as a signed long."""
    given = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("body"))
    kind = given.schema["doc_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([text_fingerprint(x.as_py(), shingle) for x in b.column(1)], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps)], names=["doc_id", "fp"])

    return given.mapInArrow(run, T.StructType([T.StructField("doc_id", kind), T.StructField("fp", T.LongType())]))


def trie_links(rest: np.ndarray, bounds: np.ndarray, split: np.ndarray, budget: int, bits: int = 2 * BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """Links (i, j) among rows, by a joint descent of each group's trie with itself.

    rest: the groups' bits, ascending within a group; bounds: where groups begin,
    and the end; split: for each group, 0 or the depth d > 0 such that only pairs
    with different d leading bits count (a group dealt out by node pairs).
    """
    found_i, found_j = [], []
    ones = np.zeros((bits, len(rest) + 1), np.int32)
    for level in range(bits):
        np.cumsum((rest >> np.uint64(bits - 1 - level)) & np.uint64(1), out=ones[level, 1:])
    lo, hi = bounds[:-1].astype(np.int64), bounds[1:].astype(np.int64)
    many = hi - lo > 1
    lo, hi, deep = lo[many], hi[many], split[many]
    todo = [(0, lo, hi, lo, hi, np.zeros(len(lo), np.int8), deep)]
    while todo:
        level, a0, a1, b0, b1, diff, deep = todo.pop()
        if not len(a0):
            continue
        if len(a0) > FRONTIER:
            cut = len(a0) // 2
            for s in (slice(None, cut), slice(cut, None)):
                todo.append((level, a0[s], a1[s], b0[s], b1[s], diff[s], deep[s]))
            continue
        # two single leaves: their remaining bits are compared at once
        leaf = (a1 - a0 == 1) & (b1 - b0 == 1)
        i, j = a0[leaf], b0[leaf]
        near = (i != j) & (np.bitwise_count(rest[i] ^ rest[j]) <= budget)
        found_i.append(i[near])
        found_j.append(j[near])
        if leaf.all() or level == bits:
            continue
        go = ~leaf
        a0, a1, b0, b1, diff, deep = (x[go] for x in (a0, a1, b0, b1, diff, deep))
        am, bm = a1 - (ones[level, a1] - ones[level, a0]), b1 - (ones[level, b1] - ones[level, b0])
        own = a0 == b0
        parts = [
            (a0, am, b0, bm, diff, deep, None),
            (am, a1, bm, b1, diff, deep, None),
            (a0, am, bm, b1, diff + 1, deep, None),
            (am, a1, b0, bm, diff + 1, deep, ~own),
        ]
        kept = []
        for x0, x1, y0, y1, d, p, also in parts:
            ok = (x1 > x0) & (y1 > y0) & (d <= budget) & ~((x0 == y0) & ((x1 - x0 == 1) | (p == level + 1)))
            ok = ok if also is None else ok & also
            kept.append([x[ok] for x in (x0, x1, y0, y1, d, p)])
        todo.append((level + 1, *(np.concatenate(x) for x in zip(*kept, strict=True))))
    if not found_i:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(found_i), np.concatenate(found_j)


def _roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest row that each row reaches over the links."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[i], root[j])
        then = root.copy()
        np.minimum.at(then, root[i], low)
        np.minimum.at(then, root[j], low)
        then = then[then]
        if np.array_equal(then, root):
            return root
        root = then


def _join_slab(key: np.ndarray, rest: np.ndarray, fp: np.ndarray, deep: np.ndarray, budget: int) -> pa.RecordBatch:
    bounds = np.concatenate([[0], np.flatnonzero(key[1:] != key[:-1]) + 1, [len(key)]])
    i, j = trie_links(rest.view(np.uint64), bounds, deep[bounds[:-1]], budget)
    root = _roots(len(key), i, j)
    moved = np.flatnonzero(root != np.arange(len(key)))
    return pa.RecordBatch.from_arrays([pa.array(fp[moved]), pa.array(fp[root[moved]])], names=["u", "v"])


def _links(budget: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for slab in _groups(batches, 4):
            yield _join_slab(*slab, budget)

    return run


def _block(fp: Column, k: int) -> Column:
    return F.shiftrightunsigned(fp, 48 - BLOCK * k).bitwiseAND(F.lit((1 << BLOCK) - 1))


def _dealt(distinct: DataFrame) -> DataFrame:
    """Rows (key, rest, fp): each fingerprint in the group of each pair of blocks."""
    fp, rows = F.col("fp"), []
    for n, (a, b) in enumerate(BLOCK_PAIRS):
        c, d = (k for k in range(4) if k not in (a, b))
        key = F.lit(n << 32) + F.shiftleft(_block(fp, a), BLOCK) + _block(fp, b)
        rows.append(F.struct(key.alias("key"), (F.shiftleft(_block(fp, c), BLOCK) + _block(fp, d)).alias("rest")))
    return distinct.select("fp", F.explode(F.array(*rows)).alias("x")).select("x.key", "x.rest", "fp")


def _spread(hot: DataFrame) -> DataFrame:
    """Deal the fingerprints of large groups out by pairs of trie nodes at HOT_DEPTH."""
    near = [0] + [1 << i for i in range(HOT_DEPTH)] + [(1 << i) | (1 << j) for i, j in combinations(range(HOT_DEPTH), 2)]
    own = F.shiftright("rest", 2 * BLOCK - HOT_DEPTH)
    return (
        hot.withColumn("own", own)
        .withColumn("flip", F.explode(F.array(*[F.lit(x).cast("long") for x in near])))
        .withColumn("other", F.col("own").bitwiseXOR(F.col("flip")))
        .select(
            # 35 bits of key, 8 and 8 of the two nodes
            (F.col("key") * (1 << 2 * HOT_DEPTH) + F.least("own", "other") * (1 << HOT_DEPTH) + F.greatest("own", "other") + F.lit(1 << 60)).alias("key"),
            "rest",
            "fp",
            F.when(F.col("flip") != 0, HOT_DEPTH).otherwise(0).cast("byte").alias("deep"),
        )
    )


def fingerprint_links(distinct: DataFrame, budget: int = BUDGET, hot_group: int = HOT_GROUP) -> DataFrame:
    """Links ``(u, v)`` that connect all distinct fingerprints ``fp`` within the budget."""
    if not 0 <= budget <= 2:
        raise ValueError("two of four equal blocks are certain only up to two differing bits")
    spark, dealt = distinct.sparkSession, _dealt(distinct)
    hot = stored(dealt.groupBy("key").count().where(F.col("count") > hot_group).select("key"), "hot")
    plain = dealt.withColumn("deep", F.lit(0).cast("byte"))
    if not hot.isEmpty():
        plain = plain.join(hot, "key", "left_anti").unionByName(_spread(dealt.join(hot, "key", "left_semi")))
    dealt_out = plain.repartition(partitions(spark), "key").sortWithinPartitions("key", "rest")
    return dealt_out.select("key", "rest", "fp", "deep").mapInArrow(_links(budget), "u long, v long")


def _classes(prints: DataFrame, links: DataFrame, *more: Column) -> DataFrame:
    """Rows ``(fp, n, root)`` and ``more`` aggregates: the class of each fingerprint, named by its least one, and the number of its rows."""
    distinct = stored(prints.groupBy("fp").agg(F.count(F.lit(1)).alias("n"), *more), "distinct")
    roots = components(links).withColumnRenamed("u", "fp")
    return stored(distinct.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp")), "classes")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", budget: int = BUDGET, shingle: int = SHINGLE, hot_group: int = HOT_GROUP) -> DataFrame:
    """Rows ``(doc_id, fingerprint, component_id)``, one for each row of ``docs``."""
    prints = stored(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    links = stored(fingerprint_links(stored(prints.select("fp").distinct(), "distinct"), budget, hot_group), "links")
    known = _classes(prints, links, F.min("doc_id").alias("first"))
    least = stored(known.groupBy("root").agg(F.min("first").alias("component_id"), F.count(F.lit(1)).alias("n")), "least")
    classes = spread_join(known.select("fp", "root", F.col("n").alias("rows")), least, "root").select("fp", F.col("rows").alias("n"), "component_id")
    return spread_join(prints, stored(classes, "classes"), "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


# --- similar texts --------------------------------------------------------------


def bands(n: int, similarity: float = SIMILARITY, recall: float = RECALL) -> tuple[int, int]:
    """Bits of a band and number of bands for so many texts."""
    bits = max(16, (max(n, 2) - 1).bit_length() - 8)
    cosine = 2 * similarity / (1 + similarity)
    agree = (1 - np.arccos(cosine) / np.pi) ** bits
    return bits, int(np.ceil(np.log(1 - recall) / np.log(1 - agree)))


def signs(sets: list[np.ndarray], bits: int) -> np.ndarray:
    """Signs of ``bits`` projections of each set of hashes, packed: sums of +1 and -1 by parities of a hash's bits."""
    size = 1 << max(12, bits.bit_length())
    x = np.zeros((len(sets), size), np.float32)
    for row, h in zip(x, sets, strict=True):
        row += np.bincount((h & np.uint64(size - 1)).astype(np.int64), 1 - 2 * (h >> np.uint64(63)).astype(np.float32), size)
    half = 1
    while half < size:
        pairs = x.reshape(len(sets), -1, 2, half)
        x = np.stack((pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]), 2).reshape(len(sets), size)
        half *= 2
    return np.packbits(x[:, 1 : bits + 1] > 0, axis=1)


def shingle_set(text: bytes | None, shingle: int = WORDS) -> np.ndarray:
    return np.unique(np.concatenate([np.zeros(0, np.uint64), *shingle_hashes(text, shingle)]))


def _sketches(shingle: int, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 128):
                b = whole.slice(at, 128)
                sets = [shingle_set(x.as_py(), shingle) for x in b.column("body")]
                fps = np.array([xxhash.xxh64_intdigest(s.tobytes(), SEED) for s in sets], np.uint64).view(np.int64)
                drawn = pa.array([r.tobytes() for r in signs(sets, bits)], pa.binary())
                yield pa.RecordBatch.from_arrays([b.column("k1"), b.column("k2"), b.column("id"), pa.array(fps), drawn], names=["k1", "k2", "id", "fp", "sketch"])

    return run


def _banded(width: int, count: int):
    """Rows (key, rest, more, fp) for each band of a sketch; rest and more are the 128 bits after the band."""
    after = (np.arange(count)[:, None] * width + width + np.arange(128)) % (width * count)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                b = whole.slice(at, 1024)
                raw = np.array([np.frombuffer(x.as_py(), np.uint8) for x in b.column("sketch")])
                drawn = np.unpackbits(raw, axis=1)[:, : width * count]
                key = drawn.reshape(-1, count, width) @ (1 << np.arange(width)[::-1]) + (np.arange(count) << width)
                rest = np.packbits(drawn[:, after], axis=2).view(">i8").astype(np.int64)
                fp = np.repeat(b.column("fp").to_numpy(), count)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (key.ravel(), rest[:, :, 0].ravel(), rest[:, :, 1].ravel(), fp)], names=["key", "rest", "more", "fp"])

    return run


_BANDED = "key long, rest long, more long, fp long"


def _groups(batches: Iterator[pa.RecordBatch], columns: int) -> Iterator[list[np.ndarray]]:
    """Columns of whole groups, sorted by the first column, in slabs."""
    held: list[list[np.ndarray]] = []
    for b in batches:
        held.append([b.column(k).to_numpy(zero_copy_only=False) for k in range(columns)])
        if sum(len(x[0]) for x in held) >= SLAB_ROWS:
            cols = [np.concatenate(x) for x in zip(*held, strict=True)]
            # the last group may go on in the next batch
            cut = int(np.searchsorted(cols[0], cols[0][-1]))
            held = [[x[cut:] for x in cols]]
            if cut:
                yield [x[:cut] for x in cols]
    if held:
        yield [np.concatenate(x) for x in zip(*held, strict=True)]


def _far(rest: np.ndarray, more: np.ndarray, i, j) -> np.ndarray:
    return np.bitwise_count(rest[i] ^ rest[j]).astype(np.int64) + np.bitwise_count(more[i] ^ more[j])


def _similar_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Near pairs of each group by 128 bits, with the bits in which they differ; rows with more than ``FEW`` partners are left to their whole sketches: no ``v``, and their group.

    A row that surely is similar to an earlier one of the group is paired with that and is
    no partner of others here; it goes on in the other bands.
    """
    for key, rest, more, fp in _groups(batches, 4):
        rest, more = rest.view(np.uint64), more.view(np.uint64)
        bounds = np.concatenate([[0], np.flatnonzero(key[1:] != key[:-1]) + 1, [len(key)]])
        # groups too large for all their pairs to be held here
        large = np.repeat(np.diff(bounds) > DENSE, np.diff(bounds))
        small = np.flatnonzero(~large)
        edges = np.append(np.searchsorted(small, bounds[:-1]), len(small))
        i, j = (small[x] for x in trie_links(rest[small], edges, np.zeros(len(edges) - 1, np.int8), LOOSE, 64)) if len(small) else (small, small)
        far = _far(rest, more, i, j)
        near = far <= CHECKED
        # the later row by fingerprint comes first
        swap = fp[i] < fp[j]
        i, j, far = np.where(swap, j, i)[near], np.where(swap, i, j)[near], far[near]
        order = np.lexsort((far, i))
        i, j, far = i[order], j[order], far[order]
        nearest = np.flatnonzero(np.diff(i, prepend=-1))
        nearest = nearest[far[nearest] <= CERTAIN]
        gone = np.zeros(len(key), bool)
        gone[i[nearest]] = True
        sure = i[nearest], j[nearest], far[nearest]
        open_ = ~gone[i] & ~gone[j]
        i, j, far = i[open_], j[open_], far[open_]
        partners = np.bincount(i, minlength=len(key)) + np.bincount(j, minlength=len(key))
        dense = (partners > FEW) | large
        listed = ~(dense[i] & dense[j])
        i, j, far = (np.concatenate([x[listed], y]) for x, y in zip((i, j, far), sure, strict=True))
        left = np.flatnonzero(dense)
        none = np.zeros(len(left), np.int64)
        v = pa.array(np.concatenate([fp[j], none]), mask=np.concatenate([np.zeros(len(j), bool), np.ones(len(left), bool)]))
        columns = [np.concatenate([fp[i], fp[left]]), v, np.concatenate([far / 128, none]), np.concatenate([none[:0], key[i], key[left]])]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["u", "v", "far", "key"])


def _thinned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a crowd with ``to``: the earlier text of the group that each surely is similar to, null for those that stay."""
    for key, rest, more, fp in _groups(batches, 4):
        rest, more = rest.view(np.uint64), more.view(np.uint64)
        to, far, known = np.zeros(len(key), np.int64), np.zeros(len(key)), np.zeros(len(key), bool)
        bounds = np.concatenate([[0], np.flatnonzero(key[1:] != key[:-1]) + 1, [len(key)]])
        for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
            left = lo + np.argsort(fp[lo:hi], kind="stable")
            while len(left) > 1:
                apart = _far(rest, more, left[1:], left[0])
                near = apart <= CERTAIN
                to[left[1:][near]], far[left[1:][near]], known[left[1:][near]] = fp[left[0]], apart[near] / 128, True
                left = left[1:][~near]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (key, rest.view(np.int64), more.view(np.int64), fp)] + [pa.array(to, mask=~known), pa.array(far)], names=["key", "rest", "more", "fp", "to", "far"])


def _nearest(bits: int, limit: float):
    """For each row of a group its ``NEAREST`` others by the whole sketch, if they may be similar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, fp, sketch in _groups(batches, 3):
            drawn = np.zeros((len(fp), -(-bits // 64) * 8), np.uint8)
            drawn[:, : -(-bits // 8)] = np.frombuffer(b"".join(sketch), np.uint8).reshape(len(fp), -1)
            drawn = drawn.view(np.uint64)
            bounds = np.concatenate([[0], np.flatnonzero(key[1:] != key[:-1]) + 1, [len(key)]])
            for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
                out = []
                step = max(1, FRONTIER // (hi - lo))
                for at in range(lo, hi, step):
                    mine = np.arange(at, min(at + step, hi))
                    apart = np.zeros((len(mine), hi - lo), np.int64)
                    for w in range(drawn.shape[1]):
                        apart += np.bitwise_count(drawn[mine, w][:, None] ^ drawn[lo:hi, w][None, :])
                    apart[np.arange(len(mine)), mine - lo] = bits + 1
                    k = min(NEAREST, hi - lo - 1)
                    if k < 1:
                        continue
                    best = np.argpartition(apart, k - 1, axis=1)[:, :k]
                    d = np.take_along_axis(apart, best, 1)
                    row, col = np.nonzero(d <= limit * bits)
                    out.append((fp[mine[row]], fp[lo + best[row, col]], d[row, col] / bits))
                if out:
                    x, y, far = (np.concatenate(c) for c in zip(*out, strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(np.maximum(x, y)), pa.array(np.minimum(x, y)), pa.array(far)], names=["u", "v", "far"])

    return run


_PAIR = "u long, v long, far double"


def similar_pairs(sketches: DataFrame, width: int, count: int, similarity: float = SIMILARITY, crowd: int = CROWD) -> tuple[DataFrame, DataFrame]:
    """Pairs (u, v, far), u above v, of fingerprints whose sketches are near, and the keys of groups with further ones; far is the share of bits that differ.

    A text has all its partners in a group if they are few, else the nearest of them by the whole sketch;
    the rest is for ``rest_links``.
    """
    spark = sketches.sparkSession
    dealt = sketches.mapInArrow(_banded(width, count), _BANDED)
    many = stored(dealt.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > crowd), "crowds")
    links = spark.createDataFrame([], _PAIR)
    if not many.isEmpty():
        parts = F.pmod(F.xxhash64("fp"), F.ceil(F.col("n") / crowd))
        rows = spread_join(dealt, many, "key").withColumn("salted", F.xxhash64("key", parts)).select("salted", "rest", "more", "fp", "key")
        salted = rows.repartition(partitions(spark), "salted").sortWithinPartitions("salted")
        # the salted key stands for the key while thinning
        thin = stored(salted.select(F.col("salted").alias("key"), "rest", "more", "fp").mapInArrow(_thinned, f"{_BANDED}, to long, far double"), "crowds-thinned")
        links = thin.where("to IS NOT NULL").select(F.col("fp").alias("u"), F.col("to").alias("v"), "far")
        gone = thin.where("to IS NOT NULL").select(F.col("key").alias("salted"), "fp")
        stay = rows.join(gone, ["salted", "fp"], "left_anti").select("key", "rest", "more", "fp")
        dealt = dealt.join(many.select("key"), "key", "left_anti").unionByName(stay)
    found = stored(dealt.repartition(partitions(spark), "key").sortWithinPartitions("key", "rest").mapInArrow(_similar_pairs, f"{_PAIR}, key long"), "near")
    links = links.unionByName(found.where("v IS NOT NULL").select("u", "v", "far"))
    bits = width * count
    threshold = np.arccos(2 * similarity / (1 + similarity)) / np.pi
    limit = float(threshold + SPREAD * np.sqrt(threshold * (1 - threshold) / bits))
    dense = found.where("v IS NULL").select("key", F.col("u").alias("fp")).join(sketches, "fp").select("key", "fp", "sketch")
    nearest = dense.repartition(partitions(spark), "key").sortWithinPartitions("key").mapInArrow(_nearest(bits, limit), _PAIR)
    short = found.where(F.col("v").isNull() | (F.col("far") <= CERTAIN / 128)).select("key").unionByName(many.select("key")).distinct()
    return links.unionByName(nearest), stored(short, "short")


def _open(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links (u, v) that connect each group's rows over all near pairs of different classes. The groups are sorted by class."""
    for key, rest, more, fp, root in _groups(batches, 5):
        rest, more = rest.view(np.uint64), more.view(np.uint64)
        bounds = np.concatenate([[0], np.flatnonzero(key[1:] != key[:-1]) + 1, [len(key)]])
        for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
            label, at, classes = np.arange(hi - lo), lo, root[lo:hi]
            while at < hi:
                # only rows of later classes are partners
                other = np.arange(lo + np.searchsorted(classes, root[at], "right"), hi)
                if not len(other):
                    break
                mine = np.arange(at, min(hi, at + max(1, FRONTIER // len(other))))
                at = mine[-1] + 1
                loose = np.bitwise_count(rest[mine][:, None] ^ rest[other][None, :])
                far = loose + np.bitwise_count(more[mine][:, None] ^ more[other][None, :])
                i, j = np.nonzero((loose <= LOOSE) & (far <= CHECKED) & (root[mine][:, None] < root[other][None, :]))
                if len(i):
                    label = _roots(hi - lo, np.concatenate([np.arange(hi - lo), mine[i] - lo]), np.concatenate([label, other[j] - lo]))
            moved = np.flatnonzero(label != np.arange(hi - lo))
            yield pa.RecordBatch.from_arrays([pa.array(fp[lo + moved]), pa.array(fp[lo + label[moved]])], names=["u", "v"])


def overlaps(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """How many shingles each set of ``left`` has in common with each of ``right``."""
    sides = [np.unique(x) for x in (left, right)]
    used = np.union1d(*sides)
    token = np.concatenate([np.zeros(0, np.uint64), *(sets[k] for k in used)])
    row = np.repeat(used, [len(sets[k]) for k in used])
    order = np.argsort(token, kind="stable")
    token, row = token[order], row[order]
    place = [np.full(len(sets), -1) for _ in sides]
    for to, side in zip(place, (left, right), strict=True):
        to[side] = np.arange(len(side))
    starts = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]])) if len(token) else np.zeros(0, np.int64)
    held = np.diff(np.append(starts, len(token)))
    holders = np.repeat(held, held)
    out = np.zeros((len(left), len(right)), np.float32)
    few = holders <= SCARCE
    t, r = token[few], row[few]
    for step in range(SCARCE if len(t) else 0):
        same = t[step:] == t[: len(t) - step]
        if not same.any():
            break
        a, b = r[: len(t) - step][same], r[step:][same]
        for x, y in ((a, b), (b, a))[: 2 if step else 1]:
            i, j = place[0][x], place[1][y]
            ok = (i >= 0) & (j >= 0)
            np.add.at(out, (i[ok], j[ok]), 1)
    column, r = np.cumsum(np.concatenate([[True], token[~few][1:] != token[~few][:-1]])) - 1 if (~few).any() else np.zeros(0, np.int64), row[~few]
    for at in range(0, int(column.max(initial=-1)) + 1, COLUMNS):
        low, high = np.searchsorted(column, [at, at + COLUMNS])
        parts = []
        for to, side in zip(place, (left, right), strict=True):
            i = to[r[low:high]]
            part = np.zeros((len(side), COLUMNS), np.float32)
            part[i[i >= 0], column[low:high][i >= 0] - at] = 1
            parts.append(part)
        out += parts[0] @ parts[1].T
    return out


def _family_links(shingle: int, similarity: float):
    """Links (u, v) that connect the similar texts of different classes of each pair of blocks."""

    def links(fp: np.ndarray, root: np.ndarray, block: np.ndarray, sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        ident, times = np.unique(root, return_counts=True)
        most = root == ident[times.argmax()]
        first, last = block == block.min(), block == block.max()
        size, rows, found = np.array([len(x) for x in sets]), np.arange(len(fp)), []
        # rows of the largest class are compared with those of others only
        for a, b in ((first & ~most, last), (first & most, last & ~most)):
            a, b = rows[a], rows[b]
            if len(a) and len(b):
                both = overlaps(sets, a, b)
                i, j = np.nonzero((both >= similarity * (size[a][:, None] + size[b][None, :] - both)) & (root[a][:, None] != root[b][None, :]))
                found.append((a[i], b[j]))
        i, j = (np.concatenate([x[k] for x in found]) if found else rows[:0] for k in (0, 1))
        label = _roots(len(fp), i, j)
        moved = np.flatnonzero(label != rows)
        return fp[moved], fp[label[moved]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        done = lambda: pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in links(*(np.array(x) for x in list(zip(*held, strict=True))[:3]), [x[3] for x in held])], names=["u", "v"])
        for b in batches:
            for group, fp, root, block, body in zip(*(b.column(k).to_pylist() for k in range(4)), b.column(4), strict=True):
                if group != now:
                    if held:
                        yield done()
                    now, held = group, []
                held.append((fp, root, block, shingle_set(body.as_py(), shingle)))
        if held:
            yield done()

    return run


def rest_links(sketches: DataFrame, short: DataFrame, roots: DataFrame, bodies, width: int, count: int, shingle: int, similarity: float) -> DataFrame:
    """Links (u, v) between the classes so far, for all partners in the groups of the keys ``short``.

    roots: rows (u, root) of the classes so far; bodies: gives rows (fp, body) for a table of fingerprints.
    """
    spark = sketches.sparkSession
    nothing = spark.createDataFrame([], "u long, v long")
    if short.isEmpty():
        return nothing
    held = stored(sketches.mapInArrow(_banded(width, count), _BANDED).join(short, "key", "left_semi"), "rest")
    root = roots.withColumnRenamed("u", "fp")
    rows = stored(held.join(root, "fp", "left").select("key", "rest", "more", "fp", F.coalesce("root", "fp").alias("root")), "rest")
    mixed = stored(rows.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count(F.lit(1)).alias("n")).where("low < high").select("key", "n"), "rest-keys")
    if mixed.isEmpty():
        return nothing
    groups = spread_join(rows, mixed, "key").select("key", "rest", "more", "fp", "root").repartition(partitions(spark), "key").sortWithinPartitions("key", "root")
    near = stored(groups.mapInArrow(_open, "u long, v long"), "rest-near")
    if near.isEmpty():
        return nothing
    joined = components(near).withColumnRenamed("root", "family")
    member = joined.select(F.col("u").alias("fp"), "family").unionByName(joined.select(F.col("family").alias("fp"), "family")).distinct()
    member = stored(member.join(root, "fp", "left").select("fp", "family", F.coalesce("root", "fp").alias("root")), "families")
    texts = stored(bodies(member.select("fp")), "family-texts")
    member = stored(member.join(texts.select("fp", F.octet_length("body").alias("size")), "fp"), "families")
    blocks = F.greatest(F.ceil(F.count(F.lit(1)) / FAMILY_ROWS), F.ceil(F.sum("size") / FAMILY_BYTES), F.lit(1)).cast("int")
    sizes = stored(member.groupBy("family").agg(blocks.alias("blocks"), F.count(F.lit(1)).alias("n")), "family-sizes")
    dealt = spread_join(member.drop("size"), sizes, "family").withColumn("block", F.pmod(F.xxhash64("fp"), "blocks").cast("int"))
    pairs = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    keyed = pairs.select(F.xxhash64("family", F.least("block", "other"), F.greatest("block", "other")).alias("group"), "fp", "root", "block").join(texts, "fp")
    return keyed.select("group", "fp", "root", "block", "body").repartition(partitions(spark), "group").sortWithinPartitions("group").mapInArrow(_family_links(shingle, similarity), "u long, v long")


def _confirmed(shingle: int, similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # sets of the texts seen last: in a family the same ones come again
        sets: dict[int, np.ndarray] = {}
        held = 0

        def of(fp: int, body: pa.Scalar) -> np.ndarray:
            nonlocal held
            if fp not in sets:
                if held > SETS:
                    sets.clear()
                    held = 0
                sets[fp] = shingle_set(body.as_py(), shingle)
                held += len(sets[fp])
            return sets[fp]

        for b in batches:
            u, v = [], []
            for mine, theirs, a, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), b.column(3), strict=True):
                x, y = of(mine, a), of(theirs, c)
                x, y = (x, y) if len(x) < len(y) else (y, x)
                both = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum()) if len(x) else 0
                if both >= similarity * (len(x) + len(y) - both):
                    u.append(mine)
                    v.append(theirs)
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    return run


def confirmed_links(pairs: DataFrame, texts: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """Rows (u, root), as of ``components``, of all texts whose pairs are similar exactly.

    In rounds, each text is compared with its nearest partners of those outside its class
    so far, more in each round and all in the last, so what is in one class already costs
    nothing and no pair between classes is left out. What a round finds is joined to the roots
    of the rounds before, stars that stand for all their links.
    """
    spark, root = pairs.sparkSession, None
    for many in ROUNDS:
        open_ = pairs
        if root is not None:
            of = lambda c: root.select(F.col("u").alias(c), F.col("root").alias(f"root_{c}"))  # noqa: E731, B023
            same = F.coalesce("root_u", "u") == F.coalesce("root_v", "v")
            open_ = pairs.join(of("u"), "u", "left").join(of("v"), "v", "left").where(~same).select("u", "v", "far")
        if many:
            open_ = open_.withColumn("turn", F.row_number().over(Window.partitionBy("u").orderBy("far", "v"))).where(F.col("turn") <= many).drop("turn")
        open_ = stored(open_.select("u", "v"), "open")
        if open_.isEmpty():
            break
        # a text of many partners is copied for each few of them: texts don't go through the driver
        times = stored(open_.groupBy("v").agg(F.count(F.lit(1)).alias("n")), "partners")
        copies = F.ceil(F.col("n") / PARTNERS)
        theirs = texts.select(F.col("fp").alias("v"), F.col("body").alias("theirs")).join(times, "v").withColumn("copy", F.explode(F.sequence(F.lit(0), copies - 1))).drop("n")
        mine = texts.select(F.col("fp").alias("u"), F.col("body").alias("mine"))
        dealt = spread_join(open_, times, "v", marks=times.agg(*size_marks()).first()).select("u", "v", F.pmod(F.xxhash64("u"), copies).alias("copy"))
        both = dealt.join(mine, "u").join(theirs, ["v", "copy"]).select("u", "v", "mine", "theirs")
        found = both.mapInArrow(_confirmed(shingle, similarity), "u long, v long")
        root = components(found if root is None else found.unionByName(root.withColumnRenamed("root", "v")))
    return spark.createDataFrame([], "u long, root long") if root is None else root


def keep_representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = WORDS, similarity: float = SIMILARITY, crowd: int = CROWD) -> DataFrame:
    """The first row of each class of similar texts, with its columns as they are: by id, nulls last, then by hash."""
    width, count = bands(docs.count(), similarity)
    keyed = docs.select(F.struct(*own(docs)).alias("row"), row_hash(docs, 1).alias("k1"), row_hash(docs, 2).alias("k2"), F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("body"))
    kind = keyed.schema["id"].dataType.simpleString()
    prints = stored(keyed.drop("row").mapInArrow(_sketches(shingle, width * count), f"k1 long, k2 long, id {kind}, fp long, sketch binary"), "sketches")
    sketches = stored(prints.groupBy("fp").agg(F.first("sketch").alias("sketch")), "sketches-by-set")
    candidates, short = similar_pairs(sketches, width, count, similarity, crowd)
    pairs = stored(candidates.groupBy("u", "v").agg(F.min("far").alias("far")), "pairs")

    def bodies(asked: DataFrame) -> DataFrame:
        """One text for each of the sets of shingles that are asked for."""
        places = prints.join(asked, "fp", "left_semi").groupBy("fp").agg(F.min(F.struct("k1", "k2")).alias("k")).select("fp", "k.k1", "k.k2")
        return keyed.select("k1", "k2", "body").join(places, ["k1", "k2"]).select("fp", "body").dropDuplicates(["fp"])

    texts = stored(bodies(pairs.select(F.col("u").alias("fp")).unionByName(pairs.select(F.col("v").alias("fp"))).distinct()), "texts")
    roots = confirmed_links(pairs, texts, shingle, similarity)
    links = roots.withColumnRenamed("root", "v").unionByName(rest_links(sketches, short, roots, bodies, width, count, shingle, similarity))
    classes = _classes(prints, links, F.min(F.struct(F.col("id").isNull().alias("last"), "id", "k1", "k2")).alias("first"))
    kept = classes.groupBy("root").agg(F.min("first").alias("first")).select("first.k1", "first.k2")
    # only rows that are the same meet here
    turn = F.row_number().over(Window.partitionBy("k1", "k2").orderBy("k1"))
    return keyed.select("row", "k1", "k2").join(kept, ["k1", "k2"], "left_semi").withColumn("turn", turn).where("turn = 1").select("row.*")
