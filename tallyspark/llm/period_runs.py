"""Periodic runs of words by Crochemore's partition refinement.

Words of a document are grouped by equality, then by equality of the L words from each
on, for L = 1, 2, 3 and so on. Going from L to L + 1, a class splits by the classes of
its members' successors; where a class has just split, all its parts but the largest are
looked at (the smaller-half strategy), so all levels together touch n log n words. The
members of a class are linked in order of place. Two neighbours whose distance is L
exactly, while factors of length L are compared, begin a square whose root is no power;
consecutive squares of one period make up a run. Levels end at the longest period that a
run can have, or when no class splits any more.

All steps are numpy operations on the classes of many documents at once, laid end to end
with a mark of its own after each; a document of any length is one of those. Documents
stay where they are: no shuffle.

Edge cases: a null text has no words, no runs and an empty collapsed text; a very long
text is one piece of work, 60 bytes or so a word; a null id is kept; repeated rows give
repeated results; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, quoted

#: A run has this many periods and this many words at least.
EXPONENT = 4
LEAST = 6
#: Words that are refined together, unless one document has more.
BATCH_WORDS = 1 << 19
WORD = r"[^\x20\x09-\x0D]+"


def _sorted_groups(a: np.ndarray, b: np.ndarray, place: np.ndarray, slots: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The triples in order."""
    bits = int(slots).bit_length()
    if 3 * bits < 63:
        packed = np.sort((a << (2 * bits)) | (b << bits) | place)
        low = (1 << bits) - 1
        return packed >> (2 * bits), (packed >> bits) & low, packed & low
    order = np.lexsort((place, b, a))
    return a[order], b[order], place[order]


def _starts(*keys: np.ndarray) -> np.ndarray:
    """Where a new combination of sorted keys begins."""
    new = np.zeros(len(keys[0]), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


def _spans(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first, first + 1, ... count times, for each of them."""
    ends = np.cumsum(count)
    return np.repeat(first - (ends - count), count) + np.arange(ends[-1] if len(ends) else 0)


def squares(words: np.ndarray, doc: np.ndarray, limit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and periods of squares with a root that is no power.

    ``words``: number of the word at each slot, the last slot of a document holding a number that
    occurs nowhere else; ``doc``: its document's number, ascending; ``limit``: the longest period asked for in it.
    """
    slots = len(words)
    none = np.int64(slots)
    first_slot = np.zeros(slots, bool)
    first_slot[_starts(doc)] = True
    # classes at L = 1; `members` holds them end to end, `start` and `size` say where, `held` is a slot's place in it
    d, w, members = _sorted_groups(doc, words, np.arange(slots), slots)
    begin = _starts(d, w)
    start, size = np.zeros(slots, np.int64), np.zeros(slots, np.int64)
    count = np.diff(begin, append=slots)
    n_classes = len(begin)
    start[:n_classes], size[:n_classes] = begin, count
    cls, held = np.empty(slots, np.int64), np.empty(slots, np.int64)
    cls[members] = np.repeat(np.arange(n_classes), count)
    held[members] = np.arange(slots)
    nxt, prv, since = np.full(slots, none), np.full(slots, -1), np.ones(slots, np.int64)
    together = cls[members[1:]] == cls[members[:-1]]
    nxt[members[:-1][together]], prv[members[1:][together]] = members[1:][together], members[:-1][together]
    # of each document all classes but the largest are looked at
    by_size = np.lexsort((count, d[begin]))
    last = np.append(d[begin][by_size][1:] != d[begin][by_size][:-1], True)
    small = by_size[~last]
    look = members[_spans(start[small], size[small])]
    found: list[tuple[np.ndarray, np.ndarray]] = []
    removed = np.zeros(slots, bool)

    def closing(at: np.ndarray, level: int) -> None:
        """The distances from ``at`` to its neighbours held up to ``level``."""
        at = at[nxt[at] < none]
        gap = nxt[at] - at
        ok = (since[at] <= gap) & (gap <= np.minimum(limit[at], level))
        found.append((at[ok], gap[ok]))

    level, deepest = 1, int(limit.max(initial=0))
    while len(look) and level < deepest:
        look = look[~first_slot[look] & (limit[look] > level)]
        before = look - 1
        before = before[size[cls[before]] > 1]
        if not len(before):
            break
        a, b, at = _sorted_groups(cls[before], cls[before + 1], before, slots)
        g = _starts(a, b)
        g_size, g_class = np.diff(g, append=len(a)), a[g]
        c = _starts(g_class)
        total = np.add.reduceat(g_size, c)
        # a class whose members all have a successor that is looked at keeps its largest group
        largest = np.maximum.reduceat(g_size, c)
        g_of = np.repeat(np.arange(len(c)), np.diff(c, append=len(g)))
        rest = size[g_class[c]] - total
        stays = np.zeros(len(g), bool)
        full = np.flatnonzero((rest == 0)[g_of] & (g_size == largest[g_of]))
        stays[full[_starts(g_of[full])]] = True
        keep = np.repeat(~stays, g_size)
        a, b, at = a[keep], b[keep], at[keep]
        look = at
        if len(at):
            g_size, g_class = g_size[~stays], g_class[~stays]
            g = np.cumsum(g_size) - g_size
            c = _starts(g_class)
            owner = g_class[c]
            moved = np.add.reduceat(g_size, c)
            # take the moved slots out of the links of their classes
            oa, _, out = _sorted_groups(a, np.zeros_like(a), at, slots)
            removed[out] = True
            p, q = prv[out], nxt[out]
            chain_from = p[(p < 0) | ~removed[p]]
            inside = q < none
            inside[inside] = removed[q[inside]]
            chain_to = q[~inside]
            removed[out] = False
            linked = chain_from >= 0
            closing(chain_from[linked], level)
            nxt[chain_from[linked]], since[chain_from[linked]] = chain_to[linked], level + 1
            linked = chain_to < none
            prv[chain_to[linked]] = chain_from[linked]
            # and link each group
            after, prior = np.append(at[1:], none), np.append(-1, at[:-1])
            after[g + g_size - 1], prior[g] = none, -1
            other = after != nxt[at]
            closing(at[other], level)
            nxt[at], prv[at] = after, prior
            since[at[other]] = level + 1
            # moved slots go to the end of their class's stretch
            tail = _spans(start[owner] + size[owner] - moved, moved)
            end = np.repeat(start[owner] + size[owner] - moved, moved)
            removed[out] = True
            stranded = members[tail]
            stranded = stranded[~removed[stranded]]
            freed = held[out][held[out] < end]
            removed[out] = False
            members[freed], held[stranded] = stranded, freed
            members[tail], held[at] = at, tail
            new = n_classes + np.arange(len(g))
            start[new], size[new] = tail[g], g_size
            cls[at] = np.repeat(new, g_size)
            n_classes += len(g)
            size[owner] -= moved
            # all parts but the largest are looked at next
            g_of = np.repeat(np.arange(len(c)), np.diff(c, append=len(g)))
            largest = np.maximum.reduceat(g_size, c)
            outgrown = largest > size[owner]
            top = np.flatnonzero(outgrown[g_of] & (g_size == largest[g_of]))
            skipped = np.zeros(len(g), bool)
            skipped[top[_starts(g_of[top])]] = True
            left = owner[outgrown]
            look = np.concatenate([at[np.repeat(~skipped, g_size)], members[_spans(start[left], size[left])]])
        level += 1
    every = np.flatnonzero(nxt < none)
    closing(every, deepest)
    return np.concatenate([x for x, _ in found]), np.concatenate([x for _, x in found])


def runs(words: list[np.ndarray], exponent: int = EXPONENT, least: int = LEAST) -> list[np.ndarray]:
    """Rows (start, length, period) by start, then period, for the word numbers of each document."""
    lengths = np.array([len(w) for w in words], np.int64)
    if not lengths.sum():
        return [np.empty((0, 3), np.int64) for _ in words]
    doc = np.repeat(np.arange(len(words)), lengths + 1)
    ends = np.cumsum(lengths + 1)
    numbers = np.empty(len(doc), np.int64)
    numbers[ends - 1] = int(max(w.max(initial=0) for w in words)) + 1
    inside = np.ones(len(doc), bool)
    inside[ends - 1] = False
    numbers[inside] = np.concatenate(words)
    at, period = squares(numbers, doc, np.repeat(lengths // exponent, lengths + 1))
    order = np.lexsort((at, period))
    at, period = at[order], period[order]
    begin = np.flatnonzero(np.append(True, (period[1:] != period[:-1]) | (at[1:] != at[:-1] + 1))) if len(at) else np.empty(0, np.int64)
    count = np.diff(begin, append=len(at))
    start, period = at[begin], period[begin]
    length = count - 1 + 2 * period
    long = length >= np.maximum(least, exponent * period)
    start, length, period = start[long], length[long], period[long]
    order = np.lexsort((period, start))
    start, length, period = start[order], length[order], period[order]
    of = doc[start]
    table = np.stack([start - (ends - lengths - 1)[of], length, period], axis=1)
    return np.split(table, np.searchsorted(of, np.arange(1, len(words))))


def kept(n: int, found: np.ndarray) -> np.ndarray:
    """Which words stay: those that no run has after its first period."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, found[:, 0] + found[:, 2], 1)
    np.add.at(change, found[:, 0] + found[:, 1], -1)
    return np.cumsum(change[:n]) == 0


def _batches(texts: Iterable[str | None]) -> Iterator[list[list[bytes]]]:
    """Words of the texts, as many texts as have ``BATCH_WORDS`` words."""
    out, held = [], 0
    for text in texts:
        # white space of bytes is that of WORD
        words = text.encode().split() if text else []
        if out and held + len(words) > BATCH_WORDS:
            yield out
            out, held = [], 0
        out.append(words)
        held += len(words)
    if out:
        yield out


FOUND = "runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed string"
RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def _detect(exponent: int, least: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            begin = 0
            for docs in _batches(batch["text"].to_pylist()):
                numbers = pa.array([w for d in docs for w in d], pa.binary()).dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
                lengths = [len(d) for d in docs]
                found = runs(np.split(numbers, np.cumsum(lengths)[:-1]), exponent, least)
                collapsed = [b" ".join(compress(d, kept(len(d), f)) if len(f) else d).decode() for d, f in zip(docs, found, strict=True)]
                flat = np.concatenate(found)
                spans = pa.StructArray.from_arrays([pa.array(flat[:, k]) for k in range(3)], fields=list(RUN))
                offsets = pa.array(np.append(0, np.cumsum([len(f) for f in found])).astype(np.int32))
                ids = batch["id"].slice(begin, len(docs))
                begin += len(docs)
                yield pa.RecordBatch.from_arrays([ids, pa.ListArray.from_arrays(offsets, spans), pa.array(collapsed, pa.string())], ["id", "runs", "collapsed"])

    return run


def detect(docs: DataFrame, id_col: str = "doc_id", text: Column | str = "text", exponent: int = EXPONENT, least: int = LEAST) -> DataFrame:
    """One row per row of ``docs``: id, its runs by start and period, and the text with each run cut to one period."""
    text = F.col(quoted(text)) if isinstance(text, str) else text
    chosen = docs.select(F.col(quoted(id_col)).alias("id"), text.alias("text"))
    kind = dict(chosen.dtypes)["id"]
    return chosen.mapInArrow(_detect(exponent, least), f"id {kind}, {FOUND}").withColumnRenamed("id", id_col)


def planted(docs: DataFrame) -> Column:
    """The texts of ``docs``; where the CRC-32 of the id ends in 0, the words after some place repeat with some period."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10)

    def repeated(w: Column) -> Column:
        n = F.size(w)
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        of = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(w, F.when(i < a, i.cast("long")).otherwise(a + (i - a) % p).cast("int")))
        return F.when(n > 0, F.array_join(of, " ")).otherwise("")

    words = F.regexp_extract_all("text", F.lit(f"({WORD})"), F.lit(1))
    return F.when(F.col("text").isNotNull() & (h % 10 == 0), let(words, repeated)).otherwise(F.col("text"))


def report(docs: DataFrame) -> DataFrame:
    """Per document: number of runs, the longest, and digests of all runs and of the collapsed text."""
    found = detect(docs, text=planted(docs))
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r.length.alias("length"), (-r.start).alias("start"), (-r.period).alias("period"))))
    lines = F.transform("runs", lambda r: F.concat(r.start.cast("string"), F.lit(","), r.length.cast("string"), F.lit(","), r.period.cast("string"), F.lit("\n")))
    return found.withColumn("top", longest).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("top.start")).alias("start"),
        F.col("top.length").alias("length"),
        (-F.col("top.period")).alias("period"),
        F.floor(1000 * F.col("top.length") / -F.col("top.period")).alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
