"""Document fingerprints by context-triggered piecewise hashing.

A rolling hash over the last ``SPAN`` bytes ends a piece wherever it is one less
than a multiple of the block size, so pieces depend on nearby bytes only and an
edit changes the pieces around it alone. A piece gives one of 64 letters. The
block size is the largest 3 * 2^k that yields at least half of ``LETTERS``
letters, not counting long repeats; a fingerprint has the letters at that size and at twice that size.
Fingerprints whose sizes are equal or a factor of two apart are compared by edit
distance at the size that they share, others are unlike.

Both hashes are sums over byte positions, so numpy computes them for a whole text
at once: the rolling hash from shifted copies, a piece's hash as a difference of
prefix sums.

``with_next`` brings each document together with the next one in ascending id:
rows are cut into ranges by id and, within an id, by the beginning of the text, at
the quantiles of a sample of about ``SAMPLE_IDS`` rows, which only decides how even
the ranges are. A range's documents are sorted in one task, and the first documents
of the next range that has any are sent along, so the whole corpus needs one shuffle
and no task depends on another.

Edge cases: a null text is empty; rows of one id follow each other by text; a
null id comes first; ids may be numbers, strings or dates; only rows of one id whose
texts begin with the same ``BEGINNING`` characters need one task; a single document
is its own next; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import mapped, partitions, plain_name

SPAN = 7
LETTERS = 64
SMALLEST = 3
RUN = 3  # a letter is repeated so often at most
SAMPLE_IDS = 20_000
SEED = 42
BEGINNING = 32
SHARED = 7  # long signatures without a common run of so many letters are unlike
_ALPHABET = np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", np.uint8)
_PRIME = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2^64
_INVERSE = pow(_PRIME, -1, 1 << 64)
_MIX = np.uint64(0xFF51AFD7ED558CCD)
_CHUNK = 1 << 16  # powers are held for so many bytes


def _powers(base: int) -> np.ndarray:
    out = np.full(_CHUNK + 1, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_POWERS, _INVERSES = _powers(_PRIME), _powers(_INVERSE)


def _levels(data: np.ndarray) -> np.ndarray:
    """For each byte, the number of block sizes at which a piece ends there."""
    n = len(data)
    wide = np.zeros(n + SPAN - 1, np.uint32)
    wide[SPAN - 1 :] = data
    h = np.zeros(n, np.uint32)
    for back in range(SPAN):
        c = wide[SPAN - 1 - back : SPAN - 1 - back + n]
        # a plain sum, a weighted sum and a shifted term, all of the window alone
        h += c * np.uint32((SPAN - back + 1) + (1 << 5 * back & 0xFFFFFFFF))
    h = (h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA6B)
    h ^= h >> np.uint32(13)
    up = h.astype(np.uint64) + np.uint64(1)
    third, rest = np.divmod(up, np.uint64(SMALLEST))
    low = third & (~third + np.uint64(1))
    level = np.bitwise_count(low - np.uint64(1)).astype(np.int64) + 1
    return np.where(rest == 0, level, 0)


def _letters(sums: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """One letter for each piece, from its sum and its start."""
    # a piece's hash must not depend on where it stands
    back = starts
    while back.any():
        step = np.minimum(back, _CHUNK)
        sums = sums * _INVERSES[step]
        back = back - step
    mixed = (sums ^ (sums >> np.uint64(32))) * _MIX
    return _ALPHABET[(mixed >> np.uint64(58)).astype(np.int64)]


def _signature(prefix: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Letters of the pieces that end before ``ends``, repeats of over ``RUN`` cut off."""
    n = len(prefix) - 1
    if not n:
        return _ALPHABET[:0]
    if not len(ends) or ends[-1] < n:
        ends = np.append(ends, n)
    starts = np.concatenate([[0], ends[:-1]])
    out = _letters(prefix[ends] - prefix[starts], starts)
    kept = np.ones(len(out), bool)
    if len(out) > RUN:
        kept[RUN:] = ~np.logical_and.reduce([out[RUN:] == out[RUN - k : -k] for k in range(1, RUN + 1)])
    places = np.flatnonzero(kept)
    if len(places) <= LETTERS:
        return out[places]
    # one piece takes the rest
    rest = starts[places[LETTERS - 1] :][:1]
    return np.concatenate([out[places[: LETTERS - 1]], _letters(prefix[n:] - prefix[rest], rest)])


def _prefix_sums(data: np.ndarray) -> np.ndarray:
    out = np.zeros(len(data) + 1, np.uint64)
    base, step, mask = 1, int(_POWERS[_CHUNK]), (1 << 64) - 1
    for at in range(0, len(data), _CHUNK):
        part = (data[at : at + _CHUNK].astype(np.uint64) + np.uint64(1)) * _POWERS[: min(_CHUNK, len(data) - at)] * np.uint64(base)
        out[at + 1 : at + 1 + len(part)] = np.cumsum(part) + out[at]
        base = base * step & mask
    return out


def fingerprint(text: bytes) -> str:
    """size:letters:letters, at a block size and at twice that."""
    data = np.frombuffer(text, np.uint8)
    n = len(data)
    level = _levels(data) if n else np.zeros(0, np.int64)
    at = np.flatnonzero(level)
    level = level[at]
    # pieces at 3 * 2^k: ends of a level above k, and the rest of the text
    counts = np.bincount(np.minimum(level, 63), minlength=65)[::-1].cumsum()[::-1]
    k = max((j for j in range(62) if counts[j + 1] >= LETTERS // 2), default=0)
    prefix = _prefix_sums(data)
    while len(own := _signature(prefix, at[level > k] + 1)) < LETTERS // 2 and k:
        k -= 1
    double = _signature(prefix, at[level > k + 1] + 1)
    return f"{SMALLEST << k}:{own.tobytes().decode()}:{double.tobytes().decode()}"


def edit_distance(a: str, b: str) -> int:
    """Levenshtein distance, a column of differences at a time in one integer."""
    if not a or not b:
        return len(a) + len(b)
    where: dict[str, int] = {}
    for k, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << k
    full, top = (1 << len(a)) - 1, 1 << len(a) - 1
    up, down, score = full, 0, len(a)
    for c in b:
        eq = where.get(c, 0)
        vertical = eq | down
        across = (((eq & up) + up) ^ up) | eq
        more, less = down | ~(across | up), up & across
        score += bool(more & top) - bool(less & top)
        more, less = more << 1 | 1, less << 1
        up, down = (less | ~(vertical | more)) & full, more & vertical & full
    return score


def _alike(a: str, b: str) -> float:
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    if min(len(a), len(b)) >= 2 * SHARED:
        runs = {a[k : k + SHARED] for k in range(len(a) - SHARED + 1)}
        if not any(b[k : k + SHARED] in runs for k in range(len(b) - SHARED + 1)):
            return 0.0
    return 1 - edit_distance(a, b) / max(len(a), len(b))


def likeness(a: str, b: str) -> float:
    """From 0 (unlike or of incompatible block sizes) to 1 (equal)."""
    if a == b:
        return 1.0
    (sa, a1, a2), (sb, b1, b2) = a.split(":"), b.split(":")
    na, nb = int(sa), int(sb)
    if na == nb:
        return max(_alike(a1, b1), _alike(a2, b2))
    if na == 2 * nb:
        return _alike(a1, b2)
    if nb == 2 * na:
        return _alike(a2, b1)
    return 0.0


def edited(text: str, following: str) -> str:
    """``text`` with its last quarter replaced by the beginning of the next text."""
    quarter = len(text) // 4
    return text[: len(text) - quarter] + following[:quarter]


def _part(cuts: list[tuple]):
    """Number of cuts at or below each row's place: (has an id, id, beginning of the text)."""

    @F.arrow_udf("int")
    def part(ids: pa.Array, beginnings: pa.Array) -> pa.Array:
        return pa.array([bisect_right(cuts, _place(i, t)) for i, t in zip(ids.to_pylist(), beginnings.to_pylist(), strict=True)], pa.int32())

    return part


def _place(ident, begin: str) -> tuple:
    return (ident is not None, ident, begin)


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (part, extra, id, text) sorted within tasks; ``extra`` rows only end a part."""
    given = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    begin = F.substring("text", 1, BEGINNING)
    places = given.select("id", begin.alias("begin"))
    parts = 4 * partitions(docs.sparkSession)
    # about SAMPLE_IDS rows
    drawn = places.sample(min(1.0, SAMPLE_IDS / max(1, places.count())), SEED).collect()
    sample = sorted(_place(*r) for r in drawn)
    cuts = sorted({sample[k * len(sample) // parts] for k in range(1, parts)}) if sample else []

    own = _part(cuts)(F.col("id"), begin)
    # at most one row for each part
    lows = {r["p"]: r["low"] for r in places.groupBy(_part(cuts)(F.col("id"), F.col("begin")).alias("p")).agg(F.min(F.struct("id", "begin")).alias("low")).collect()}
    order = sorted(lows)
    # the first rows of a part go to the part before it too, those of the first part to the last
    before = {p: order[k - 1] for k, p in enumerate(order)}
    firsts = docs.sparkSession.createDataFrame([(p, lows[p]["id"], lows[p]["begin"], before[p]) for p in order], T.StructType([T.StructField("own", T.IntegerType()), T.StructField("low", given.schema["id"].dataType), T.StructField("begin", T.StringType()), T.StructField("to", T.IntegerType())]))
    placed = given.withColumn("own", own).join(F.broadcast(firsts), "own")
    to = F.when(F.col("id").eqNullSafe(F.col("low")) & (begin == F.col("begin")), F.col("to"))
    both = F.array_compact(F.array(F.struct(F.col("own").alias("part"), F.lit(0).alias("extra")), F.when(to.isNotNull(), F.struct(to.alias("part"), F.lit(1).alias("extra")))))
    dealt = placed.select("id", "text", F.explode(both).alias("x")).select(F.col("x.part").alias("part"), F.col("x.extra").alias("extra"), "id", "text")
    return dealt.repartition(partitions(docs.sparkSession), "part").sortWithinPartitions("part", "extra", F.col("id").asc_nulls_first(), "text")


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = None  # part, id, text, fingerprint of the row that waits for its next

    def row(held, following: str, theirs: str) -> tuple:
        _, ident, text, mine = held
        new = edited(text, following).encode()
        changed = fingerprint(new)
        return ident, len(text), hashlib.sha256(new).hexdigest(), mine, changed, likeness(mine, changed), likeness(mine, theirs)

    for b in batches:
        out = []
        for part, extra, ident, text in zip(*(b.column(k) for k in range(4)), strict=True):
            part, extra, text = part.as_py(), extra.as_py(), text.as_py()
            if held is None and extra:
                continue
            mine = fingerprint(text.encode())
            if held is not None and held[0] == part:
                out.append(row(held, text, mine))
            held = None if extra else (part, ident.as_py(), text, mine)
        if out:
            ids, chars, shas, prints, others, near, follow = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, b.column(2).type), pa.array(chars, pa.int64()), pa.array(shas), pa.array(prints), pa.array(others), pa.array(near), pa.array(follow)],
                names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
            )


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its fingerprint, that of its edited text, and likenesses."""
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return with_next(docs, id_col, text_col).mapInArrow(_compare, schema)


def fingerprints(docs: DataFrame, text_col: str = "text", out: str = "fingerprint") -> DataFrame:
    """``docs`` with the fingerprint of each text."""
    name = plain_name(docs, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(b.schema.get_field_index(name)).cast(pa.binary())
            prints = [fingerprint(x.as_py() or b"") for x in texts]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(prints, pa.string())], names=[*b.schema.names, out])

    return mapped(docs, run, T.StructField(out, T.StringType()))
