"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Every ``window`` consecutive words of a benchmark item are a pattern (an item of
fewer words is one pattern as a whole). The search works on words, not bytes: a
block is the last ``BLOCK`` words of the search position. A shift table says for
each block that patterns hold how far the position may move, any other block
moves it by the most; blocks that end a pattern's first m words select a bucket
of patterns, which are compared directly.

The patterns are dealt into parts of about ``PART_WORDS`` words, each a broadcast
of its own. A task holds one part at a time: it reads ``SLAB_BYTES`` of texts and
searches them for one part after the other, so its memory doesn't grow with the
benchmark, the corpus is read once and nothing is shuffled. Items of over
``SEGMENT_WORDS`` words are cut into overlapping segments first. Equal patterns are
one, whatever items and places they come from.

Edge cases: null or wordless texts have no words, aren't contaminated and are
kept; null or wordless items have no patterns; items that share an id count once;
a null item_id reads "null"; repeated rows are judged one by one; either table
may be empty; other columns pass through untouched, whatever their names.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import mapped, plain_name, stored, unused

WINDOW = 13
BLOCK = 3
HIT_SHARE = 20  # contaminated: a word in so many is hit
PART_WORDS = 200_000
SEGMENT_WORDS = 4_096
SLAB_BYTES = 1 << 25
#: Patterns of lengths between two of these share a shift table.
LENGTH_CLASSES = (1, 2, 4, 8, 13)
NOTES = "__decontamination"

_WORD_BYTES = bytes([*b"0123456789abcdefghijklmnopqrstuvwxyz", *range(0x80, 0x100)])
_UPPER = {u: u + 32 for u in range(65, 91)}
#: Upper case to lower case, word bytes to themselves, all else to a blank.
_FOLD = bytes(_UPPER.get(b, b if b in _WORD_BYTES else 32) for b in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(_FOLD).split() if text else []


class WuManber:
    """Occurrences of patterns of ``shortest`` words or more in a list of words."""

    def __init__(self, patterns: list[tuple[bytes, ...]], shortest: int):
        self.m, self.b = shortest, min(BLOCK, shortest)
        self.most = self.m - self.b + 1
        self.shift: dict[tuple[bytes, ...], int] = {}
        #: block -> length -> the patterns of that length, with their numbers
        self.bucket: dict[tuple[bytes, ...], dict[int, dict[tuple[bytes, ...], int]]] = {}
        for number, p in enumerate(patterns):
            for end in range(self.b, self.m + 1):
                block, left = p[end - self.b : end], self.m - end
                if left < self.shift.get(block, self.most):
                    self.shift[block] = left
                if not left:
                    self.bucket.setdefault(block, {}).setdefault(len(p), {})[p] = number

    def occurrences(self, words: list[bytes]) -> Iterator[tuple[int, int, int]]:
        """(number of the pattern, start, end) of each occurrence."""
        get, bucket, most, b, m, n, at = self.shift.get, self.bucket, self.most, self.b, self.m, len(words), self.m
        while at <= n:
            block = tuple(words[at - b : at])
            if by := get(block, most):
                at += by
                continue
            begin = at - m
            for length, ending in bucket[block].items():
                # the lookup compares words with words: only an equal pattern is found
                number = ending.get(tuple(words[begin : begin + length]))
                if number is not None:
                    yield number, begin, begin + length
            at += 1


class Matcher:
    """The search for one part of the benchmark."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int = WINDOW):
        owners: dict[tuple[bytes, ...], set[int]] = {}
        self.names = [name for name, _ in items]
        for t, (_, words) in enumerate(items):
            length = min(window, len(words))
            for at in range(len(words) - length + 1 if length else 0):
                owners.setdefault(tuple(words[at : at + length]), set()).add(t)
        classes: dict[int, list[tuple[bytes, ...]]] = {}
        for p in owners:
            classes.setdefault(max(x for x in LENGTH_CLASSES if x <= len(p)), []).append(p)
        self.searches = [(WuManber(p, min(map(len, p))), [owners[x] for x in p]) for _, p in sorted(classes.items())]

    def search(self, words: list[bytes]) -> tuple[list[int], set[str]]:
        """Places of the words that are hit, and the items that hit them."""
        hit, found = None, set()
        for s, owners in self.searches:
            seen = set()
            for number, begin, end in s.occurrences(words):
                hit = hit or bytearray(len(words))
                hit[begin:end] = b"\1" * (end - begin)
                seen.add(number)
            found.update(*(owners[k] for k in seen))
        return [k for k, x in enumerate(hit) if x] if hit else [], {self.names[t] for t in found}


def _segments(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names, bodies = [], []
            for name, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                words = words_of(text)
                for at in range(0, max(1, len(words) - window + 1) if words else 0, SEGMENT_WORDS):
                    names.append(name)
                    bodies.append(b" ".join(words[at : at + SEGMENT_WORDS + window - 1]))
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(bodies, pa.binary()), pa.array([x.count(b" ") + 1 for x in bodies], pa.int64())], names=["item", "body", "n"])

    return run


def _parts(bench: DataFrame, id_col: str, text_col: str, window: int, part_words: int) -> tuple[DataFrame, int]:
    given = bench.select(F.coalesce(F.col(id_col).cast("string"), F.lit("null")).alias("item"), F.col(text_col).cast("binary").alias("body"))
    # repeated rows and repeated segments of an item are one
    cut = stored(given.mapInArrow(_segments(window), "item string, body binary, n long").distinct(), "benchmark")
    total = cut.agg(F.sum("n")).first()[0] or 0
    return cut.withColumn("part", F.pmod(F.xxhash64("item", "body"), F.lit(parts := max(1, -(-total // part_words))))), parts


_MATCHERS: dict[tuple[str, int], Matcher] = {}


def _slabs(batches: Iterator[pa.RecordBatch], bound: int) -> Iterator[list[pa.RecordBatch]]:
    """Batches together until they have ``bound`` bytes."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        held.append(b)
        if sum(x.nbytes for x in held) >= bound:
            yield held
            held = []
    if held:
        yield held


def _scan(parts: list, window: int, text_col: str, notes_col: str):
    """Adds a struct to rows: n_words, the places hit, the items found."""
    mine = uuid.uuid4().hex

    def matcher(k: int) -> Matcher:
        if (mine, k) not in _MATCHERS:
            _MATCHERS.clear()
            _MATCHERS[mine, k] = Matcher([(name, body.split()) for name, body in parts[k].value], window)
        return _MATCHERS[mine, k]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # one part needs no slabs: each batch is done as it comes
        for held in _slabs(batches, SLAB_BYTES if len(parts) > 1 else 0):
            texts = [b.column(b.schema.get_field_index(text_col)).cast(pa.binary()) for b in held]
            n_words, hits, items = ([[None] * b.num_rows for b in held] for _ in range(3))
            for k in range(len(parts)):
                search = matcher(k).search
                for i, column in enumerate(texts):
                    for j, text in enumerate(column):
                        words = words_of(text.as_py())
                        hit, found = search(words)
                        n_words[i][j] = len(words)
                        hits[i][j] = sorted({*hits[i][j], *hit}) if hits[i][j] else hit
                        items[i][j] = items[i][j] | found if items[i][j] else found
            for b, n, h, f in zip(held, n_words, hits, items, strict=True):
                notes = pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(h, pa.list_(pa.int32())), pa.array(map(sorted, f), pa.list_(pa.string()))], names=["n_words", "hit", "items"])
                yield pa.RecordBatch.from_arrays([*b.columns, notes], names=[*b.schema.names, notes_col])

    return run


def annotate(docs: DataFrame, bench: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, part_words: int = PART_WORDS, notes: str = NOTES) -> DataFrame:
    """``docs`` with a struct ``notes``: n_words, hit (places of words), items (ids as strings, sorted)."""
    spark, (cut, parts) = docs.sparkSession, _parts(bench, item_col, item_text_col, window, part_words)

    def shared(part: int):
        # about part_words words, by the count above
        rows = cut.where(F.col("part") == part).select("item", "body").collect()
        return spark.sparkContext.broadcast([(r.item, bytes(r.body)) for r in rows])

    kind = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("hit", T.ArrayType(T.IntegerType())), T.StructField("items", T.ArrayType(T.StringType()))])
    return mapped(docs, _scan([shared(k) for k in range(parts)], window, plain_name(docs, text_col), notes), T.StructField(notes, kind))


def _contaminated(notes: str = NOTES) -> Column:
    n_hit = F.size(f"{notes}.hit").cast("long")
    return (n_hit > 0) & (HIT_SHARE * n_hit >= F.col(f"{notes}.n_words"))


def report(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row per document: words, words hit, items found, verdict."""
    noted = annotate(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), bench, **options)
    return noted.select(
        "doc_id",
        F.col(f"{NOTES}.n_words").alias("n_words"),
        F.size(f"{NOTES}.hit").cast("long").alias("n_hit"),
        F.size(f"{NOTES}.items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", f"{NOTES}.items"), 256).alias("items_sha256"),
        _contaminated().alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, bench: DataFrame, **options) -> DataFrame:
    """The documents that aren't contaminated, with their columns as they are."""
    (notes,) = unused(docs, NOTES)
    return annotate(docs, bench, notes=notes, **options).where(~_contaminated(notes)).drop(notes)


_SPLIT_SQL = "list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')"

#: The same report by joining every window of the documents with those of the items.
ORACLE_SQL = f"""
WITH i AS (SELECT coalesce(item_id::VARCHAR, 'null') AS item, {_SPLIT_SQL} AS w FROM benchmark),
p AS (SELECT DISTINCT item, least(13, len(w)) AS size, array_to_string(w[s.s:s.s + least(13, len(w)) - 1], ' ') AS pat FROM i, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS s(s) WHERE len(w) > 0),
z AS (SELECT DISTINCT size FROM p),
d AS (SELECT row_number() OVER () AS k, doc_id, {_SPLIT_SQL} AS w FROM documents),
v AS (SELECT d.k, s.s AS at, z.size, array_to_string(d.w[s.s:s.s + z.size - 1], ' ') AS pat FROM d, z, unnest(range(1, len(d.w) - z.size + 2)) AS s(s)),
h AS (SELECT v.k, v.at, v.size, p.item FROM v JOIN p USING (size, pat)),
c AS (SELECT k, count(DISTINCT u.u) AS n_hit FROM h, unnest(range(h.at, h.at + h.size)) AS u(u) GROUP BY k),
n AS (SELECT k, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM h GROUP BY k)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(c.n_hit, 0)::BIGINT AS n_hit, coalesce(n.n_items, 0)::BIGINT AS n_items, sha256(coalesce(n.items, '')) AS items_sha256,
       coalesce(c.n_hit > 0 AND 20 * c.n_hit >= len(d.w), false) AS contaminated
FROM d LEFT JOIN c USING (k) LEFT JOIN n USING (k)
"""
