"""Language identification: words first, then ever shorter character n-grams.

A word that the model knows scores by its log frequency in each language. An
unknown word is read as its character n-grams (with marks at both ends) of the
longest order of which the model knows any, scored by their mean log frequency
in each language. A text's evidence is the mean over its words; the score is the
best language's share of exp(evidence * min(words, STEADY)).

The tables are learned from at most about ``SAMPLE_DOCS`` labelled documents, an
equal number for each language, drawn by a hash of the id. Their whole texts are
counted on the executors and all their entries are kept, whatever the number of
languages; the sample bounds what is collected and broadcast. A table holds only
the languages that an entry occurs in (rows of a sparse matrix), the others share
what an unseen entry scores in them.

Edge cases: null texts and texts without a letter are "und" with score 0, as is
every text if nothing could be learned; a null id is never learned from and
isn't held out; ties go to the language first by code point; repeated rows are
all returned; a language is any non-null value; texts of any length are read whole;
other columns pass through untouched.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import mapped, plain_name, stored, unused

UNKNOWN = "und"
ORDERS = (4, 3, 2, 1)
SAMPLE_DOCS = 20_000
BROADCAST_LANGS = 100_000
STEADY = 20
SMOOTH = 0.5
KEEP_SCORE = 0.3  # below that, no language stands out
FOLDS, HELD_OUT = 4, 2
_WORD = re.compile(r"[^\W\d_]+")
_CACHED = 250_000  # numbers kept for unknown words
_PLACES = 50_000  # words whose rows are kept, besides those of one text
_SCHEMA = pa.schema([("lang", pa.string()), ("kind", pa.int32()), ("entry", pa.string()), ("n", pa.int64()), ("total", pa.int64())])


def fold(id_col: Column, folds: int) -> Column:
    return F.crc32(id_col.cast("string").cast("binary")) % folds


def _hash(entry: str | pa.StringScalar) -> int:
    return xxhash.xxh64_intdigest(str(entry).encode())


def _grams(word: str, order: int) -> list[str]:
    marked = f"<{word}>"
    return [marked[k : k + order] for k in range(max(1, len(marked) - order + 1))]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of words (order 0) and n-grams by language, as far as a batch goes."""
    for b in batches:
        words: dict[str, Counter] = {}
        for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            words.setdefault(lang, Counter()).update(_WORD.findall(text.lower()))
        n: Counter = Counter()
        for lang, found in words.items():
            for w, k in found.items():
                n[lang, 0, w] += k
                for order in ORDERS:
                    for g in _grams(w, order):
                        n[lang, order, g] += k
        keys = list(n)
        yield pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int32()), pa.array([k[2] for k in keys], pa.string()), pa.array([n[k] for k in keys], pa.int64())],
            names=["lang", "kind", "entry", "n"],
        )


class Model:
    """Log frequencies by language.

    ``tables[order]`` has the 64-bit hashes of the entries, ascending, and their rows: a
    tenth of the memory of a dictionary in each Python worker. Row r has the languages
    ``lang[ptr[r]:ptr[r + 1]]`` that it occurs in and how far its log frequency there
    exceeds ``base[kind]``, that of an entry never seen.
    """

    def __init__(self, rows: pa.Table | list[tuple[str, int, str, int, int]]):
        """rows: (language, order or 0 for words, entry, count, count of all of that kind)."""
        if not isinstance(rows, pa.Table):
            rows = pa.table(dict(zip(_SCHEMA.names, map(list, zip(*rows, strict=True)) if rows else ([],) * 5, strict=True)), schema=_SCHEMA)
        rows = rows.sort_by([("kind", "ascending"), ("entry", "ascending"), ("lang", "ascending")])
        lang, kind, entry = rows["lang"].combine_chunks().dictionary_encode(), rows["kind"].to_numpy(), rows["entry"].combine_chunks()
        count, total = rows["n"].to_numpy(), rows["total"].to_numpy()
        self.langs = sorted(lang.dictionary.to_pylist())
        place = {x: k for k, x in enumerate(self.langs)}
        # languages by their places in code point order
        self.lang = np.array([place[x] for x in lang.dictionary.to_pylist()], np.int32)[lang.indices.to_numpy()]
        begins = np.ones(len(rows), bool)
        begins[1:] = (kind[1:] != kind[:-1]) | pc.not_equal(entry[1:], entry[:-1]).to_numpy(zero_copy_only=False)
        starts = np.flatnonzero(begins)
        self.ptr = np.append(starts, len(rows))
        self.tables, self.base = {}, {}
        for k in (0, *ORDERS):
            low, high = np.searchsorted(kind[starts], [k, k + 1])
            hashes = np.fromiter(map(_hash, entry.take(pa.array(starts[low:high]))), np.uint64, high - low)
            order = np.argsort(hashes)
            self.tables[k] = hashes[order], (low + order).astype(np.int32)
            # a language without entries of a kind knows as little as the fullest table lets it
            totals, own = np.zeros(len(self.langs)), kind == k
            totals[self.lang[own]] = total[own]
            totals = np.where(totals > 0, totals, totals.max(initial=0))
            self.base[k] = np.log(SMOOTH / (totals + SMOOTH * max(1, high - low)))
        self.over = np.log((count + SMOOTH) / SMOOTH)
        self.cache: dict[str, np.ndarray | None] = {}
        self.seen: dict[str, int] = {}

    def _rows(self, kind: int, entries: list[str]) -> list[int]:
        """Rows of the entries, -1 for those that aren't in the table."""
        hashes, rows = self.tables[kind]
        if not len(hashes):
            return [-1] * len(entries)
        own = np.fromiter(map(_hash, entries), np.uint64, len(entries))
        at = np.minimum(np.searchsorted(hashes, own), len(hashes) - 1)
        return np.where(hashes[at] == own, rows[at], -1).tolist()

    def _excess(self, rows: list[int], times: list[int] | None = None) -> np.ndarray:
        """Sum of the rows, each so many times, by language."""
        r = np.array(rows)
        n = self.ptr[r + 1] - self.ptr[r]
        at = np.repeat(self.ptr[r] - n.cumsum() + n, n) + np.arange(n.sum())
        over = self.over[at] if times is None else self.over[at] * np.repeat(times, n)
        return np.bincount(self.lang[at], over, len(self.langs))

    def unknown(self, word: str) -> np.ndarray | None:
        """Evidence of a word that isn't in the table of words."""
        for order in ORDERS:
            rows = [r for r in self._rows(order, _grams(word, order)) if r >= 0]
            if rows:
                return self.base[order] + self._excess(rows) / len(rows)
        return None

    def predict(self, text: str | None) -> tuple[str, float]:
        words = _WORD.findall(text.lower()) if text else []
        if not self.langs or not any(c.isalpha() for w in words for c in w):
            return UNKNOWN, 0.0
        place, cache = self.seen, self.cache
        rows, times, total, seen = [], [], np.zeros(len(self.langs)), 0
        counts = Counter(words)
        if len(place) >= _PLACES:
            place.clear()
        if new := [w for w in counts if w not in place]:
            place.update(zip(new, self._rows(0, new), strict=True))
        for w, n in counts.items():
            if (r := place[w]) >= 0:
                rows.append(r)
                times.append(n)
                continue
            if w not in cache:
                if len(cache) * len(self.langs) >= _CACHED:
                    cache.clear()
                cache[w] = self.unknown(w)
            if (found := cache[w]) is not None:
                total += n * found
                seen += n
        if rows:
            total += self._excess(rows, times) + sum(times) * self.base[0]
            seen += sum(times)
        if not seen:
            return self.langs[0], 1 / len(self.langs)
        power = total / seen * min(len(words), STEADY)
        best = int(power.argmax())
        return self.langs[best], float(1 / np.exp(power - power[best]).sum())


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_docs: int = SAMPLE_DOCS, learn_from: Column | None = None) -> Model:
    """Fit the tables on a bounded sample of the labelled documents."""
    given = docs.where(F.lit(True) if learn_from is None else learn_from).select(F.col(lang_col).cast("string").alias("lang"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    given = given.where("lang IS NOT NULL AND text IS NOT NULL AND id IS NOT NULL")
    sizes = stored(given.groupBy("lang").count(), "languages")
    n_langs = sizes.count()
    if not n_langs:
        return Model([])
    quota = sizes.select("lang", F.least(F.lit(1.0), F.lit(sample_docs / n_langs) / F.col("count")).alias("share"))
    draw = F.pmod(F.xxhash64(F.lit("language"), "id"), F.lit(1 << 30)) < F.col("share") * (1 << 30)
    # of more languages than can be broadcast, each has few documents
    sample = given.join(F.broadcast(quota) if n_langs <= BROADCAST_LANGS else quota, "lang").where(draw).select("lang", "text")
    counts = stored(sample.mapInArrow(_count, "lang string, kind int, entry string, n long").groupBy("lang", "kind", "entry").agg(F.sum("n").alias("n")), "grams")
    totals = counts.groupBy("lang", "kind").agg(F.sum("n").alias("total"))
    # entries of about sample_docs documents, and no more languages than documents
    return Model(counts.join(F.broadcast(totals), ["lang", "kind"]).select(*_SCHEMA.names).toArrow())


_MODELS: dict[str, Model] = {}


def _label(model, text_col: str, out: str):
    mine = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if mine not in _MODELS:
            _MODELS.clear()
            _MODELS[mine] = model.value
        predict = _MODELS[mine].predict
        for b in batches:
            found = [predict(x.as_py()) for x in b.column(b.schema.get_field_index(text_col))]
            verdict = pa.StructArray.from_arrays([pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], names=["lang", "score"])
            yield pa.RecordBatch.from_arrays([*b.columns, verdict], names=[*b.schema.names, out])

    return run


def identify(docs: DataFrame, model: Model, text_col: str = "text", out: str = "__language") -> DataFrame:
    """``docs`` with the struct ``out``: lang, score."""
    verdict = T.StructType([T.StructField("lang", T.StringType()), T.StructField("score", T.DoubleType())])
    model.cache, model.seen = {}, {}
    # as large as the sampled documents' entries
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return mapped(docs, _label(shared, plain_name(docs, text_col), out), T.StructField(out, verdict))


def predictions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """One row per document, learned without the held-out fold."""
    model = learn(docs, id_col, text_col, lang_col, sample_docs, fold(F.col(id_col), FOLDS) != HELD_OUT)
    read = identify(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), model)
    held = F.coalesce(fold(F.col("doc_id"), FOLDS) == HELD_OUT, F.lit(False))
    return read.select("doc_id", held.alias("held_out"), F.col("__language.lang").alias("lang_pred"), F.col("__language.score").alias("score"))


def keep_identified(docs: DataFrame, keep_score: float = KEEP_SCORE, **options) -> DataFrame:
    """Drop the documents without letters or without a language of ``keep_score``."""
    options.setdefault("learn_from", fold(F.col(options.get("id_col", "doc_id")), FOLDS) != HELD_OUT)
    model, (out,) = learn(docs, **options), unused(docs, "__language")
    read = identify(docs, model, options.get("text_col", "text"), out)
    return read.where((F.col(f"{out}.lang") != UNKNOWN) & (F.col(f"{out}.score") >= keep_score)).drop(out)
