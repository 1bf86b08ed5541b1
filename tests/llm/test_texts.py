import hashlib
import html
import math
import random
import re
import time
from zlib import crc32

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyspark.llm import fuzzy_fingerprint as f
from tallyspark.llm import html_blocks, html_extract
from tallyspark.llm import language_id as g
from tallyspark.llm import line_dedup as ld
from tallyspark.llm import quality as q


# --- fingerprints ---------------------------------------------------------------


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        left, row[0] = row[0], i + 1
        for j, y in enumerate(b):
            left, row[j + 1] = row[j + 1], min(row[j + 1] + 1, row[j] + 1, left + (x != y))
    return row[-1]


def test_edit_distance():
    rng = random.Random(1)
    for _ in range(300):
        a, b = ("".join(rng.choices("abcd", k=rng.randint(0, 64))) for _ in range(2))
        assert f.edit_distance(a, b) == levenshtein(a, b)


def test_pieces_depend_on_nearby_bytes_only():
    rng = random.Random(2)
    text = bytes(rng.choices(range(97, 123), k=20_000))
    same = f.fingerprint(text)
    assert f.fingerprint(bytes(text)) == same
    moved = f.fingerprint(b"a new beginning " + text)
    other = f.fingerprint(bytes(rng.choices(range(97, 123), k=20_000)))
    assert f.likeness(same, moved) > 0.9
    assert f.likeness(same, other) == 0
    assert f.likeness(same, same) == 1


def test_prefix_sums_over_chunks():
    rng = random.Random(3)
    text = bytes(rng.choices(range(256), k=f._CHUNK * 2 + 777))
    far = bytes(rng.choices(range(256), k=f._CHUNK + 13)) + text
    assert f.likeness(f.fingerprint(text), f.fingerprint(far)) > 0.3


M64, M32 = (1 << 64) - 1, (1 << 32) - 1
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"


def trigger(data, i):
    """Hash of the last seven bytes up to byte i."""
    h = 0
    for back in range(7):
        c = data[i - back] if i >= back else 0
        h += c * (8 - back + (1 << 5 * back & M32))
    h &= M32
    h = (h ^ h >> 15) * 0x85EBCA6B & M32
    return h ^ h >> 13


def letter(piece):
    total = 0
    for k, c in enumerate(piece):
        total += (c + 1) * pow(0x9E3779B97F4A7C15, k, 1 << 64)
    total &= M64
    mixed = (total ^ total >> 32) * 0xFF51AFD7ED558CCD & M64
    return ALPHABET[mixed >> 58]


def signature(data, size, marks):
    cuts = [0, *(i + 1 for i in range(len(data)) if marks[i] % size == size - 1)]
    if len(data) > cuts[-1]:
        cuts.append(len(data))
    letters = [letter(data[x:y]) for x, y in zip(cuts, cuts[1:], strict=False)]
    kept = [k for k in range(len(letters)) if k < 3 or len(set(letters[k - 3 : k + 1])) > 1]
    if len(kept) <= 64:
        return "".join(letters[k] for k in kept)
    return "".join(letters[k] for k in kept[:63]) + letter(data[cuts[kept[63]] :])


def plain_fingerprint(data):
    marks = [trigger(data, i) for i in range(len(data))]
    size = 3
    while sum(m % (2 * size) == 2 * size - 1 for m in marks) >= 32:
        size *= 2
    while len(own := signature(data, size, marks)) < 32 and size > 3:
        size //= 2
    return f"{size}:{own}:{signature(data, 2 * size, marks)}"


def plain_likeness(a, b):
    def alike(x, y):
        if x == y:
            return 1.0
        if not x or not y:
            return 0.0
        if min(len(x), len(y)) >= 14 and not any(x[k : k + 7] in y for k in range(len(x) - 6)):
            return 0.0
        return 1 - levenshtein(x, y) / max(len(x), len(y))

    (sa, a1, a2), (sb, b1, b2) = a.split(":"), b.split(":")
    if a == b:
        return 1.0
    pairs = {1: [(a1, b1), (a2, b2)], 2: [(a1, b2)], 0.5: [(a2, b1)]}.get(int(sa) / int(sb), [])
    return max((alike(x, y) for x, y in pairs), default=0.0)


def test_fingerprint_against_a_plain_one():
    rng = random.Random(9)
    for n in (0, 1, 5, 100, 1000, 6000):
        for alphabet in (b"ab", b"aaaaaaaab", bytes(range(256)), b"the quick brown fox "):
            text = bytes(rng.choices(alphabet, k=n))
            assert f.fingerprint(text) == plain_fingerprint(text)


def test_report_against_brute_force(docs, rows, no_docs):
    own = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    want = []
    for k, r in enumerate(own):
        text, following = r[1] or "", own[(k + 1) % len(own)][1] or ""
        quarter = len(text) // 4
        edited = text[: len(text) - quarter] + following[:quarter]
        mine, changed, theirs = (plain_fingerprint(t.encode()) for t in (text, edited, following))
        want.append((r[0], len(text), hashlib.sha256(edited.encode()).hexdigest(), mine, changed, plain_likeness(mine, changed), plain_likeness(mine, theirs)))
    assert sorted(map(tuple, f.report(docs).collect()), key=repr) == sorted(want, key=repr)
    assert f.report(no_docs).count() == 0


def test_next_document_of_any_ordered_id(spark):
    for ids, kind in (([None, "b", "a", "a", "é", "aa", None], "string"), ([2**62 + 1, 2**62, None, 5, 5, -1, 7], "long")):
        rows = [(i, f"text number {k} " * (k + 3)) for k, i in enumerate(ids)]
        own = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0 if kind == "long" else r[0] or "", r[1]))
        want = sorted((repr(r[0]), hashlib.sha256((r[1][: len(r[1]) - (q := len(r[1]) // 4)] + own[(k + 1) % len(own)][1][:q]).encode()).hexdigest()) for k, r in enumerate(own))
        got = f.report(spark.createDataFrame(rows, f"doc_id {kind}, text string").repartition(3)).collect()
        assert sorted((repr(r.doc_id), r.edited_sha256) for r in got) == want


# --- languages ------------------------------------------------------------------


def test_language_id(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = g.predictions(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert len(got) and (got["lang_pred"] == got["lang"]).mean() > 0.97
    assert got["score"].between(0, 1).all()


def test_backoff_goes_from_words_to_shorter_grams():
    rows = [("a", 0, "word", 5, 10), ("b", 0, "other", 5, 10), ("a", 4, "<qux", 3, 10), ("b", 2, "zz", 4, 10), ("a", 1, "y", 2, 10)]
    m = g.Model(rows)
    assert m.predict("word word")[0] == "a"
    assert m.predict("Other")[0] == "b"
    assert m.predict("quxqux")[0] == "a"
    assert m.predict("zz")[0] == "b"
    assert m.predict("y")[0] == "a"
    assert m.predict("123 _ !")[0] == g.UNKNOWN
    assert m.predict(None) == (g.UNKNOWN, 0.0)


def grams(word, order):
    marked = f"<{word}>"
    return [marked[k : k + order] for k in range(max(1, len(marked) - order + 1))]


class PlainLanguages:
    """Word-first backoff on dictionaries, one language at a time."""

    def __init__(self, docs):
        self.n = {}
        for lang, text in docs:
            for w in re.findall(r"[^\W\d_]+", text.lower()):
                for kind, entries in ((0, [w]), *((o, grams(w, o)) for o in (4, 3, 2, 1))):
                    for e in entries:
                        own = self.n.setdefault(kind, {}).setdefault(lang, {})
                        own[e] = own.get(e, 0) + 1
        self.langs = sorted({lang for lang, _ in docs})

    def log(self, kind, lang, entry):
        every = {e for own in self.n[kind].values() for e in own} if kind not in self.__dict__.setdefault("sizes", {}) else None
        if every is not None:
            self.sizes[kind] = (every, max(sum(own.values()) for own in self.n[kind].values()))
        known, fullest = self.sizes[kind]
        own = self.n[kind].get(lang, {})
        total = self.__dict__.setdefault("totals", {}).setdefault((kind, lang), sum(own.values()) or fullest)
        return math.log((own.get(entry, 0) + 0.5) / (total + 0.5 * len(known))) if entry in known else None

    def predict(self, text):
        words = re.findall(r"[^\W\d_]+", (text or "").lower())
        if not any(c.isalpha() for w in words for c in w):
            return "und", 0.0
        power = []
        for lang in self.langs:
            found = []
            for w in words:
                for kind in (0, 4, 3, 2, 1):
                    logs = [x for e in ([w] if kind == 0 else grams(w, kind)) if (x := self.log(kind, lang, e)) is not None]
                    if logs:
                        found.append(sum(logs) / len(logs))
                        break
            power.append(sum(found) / len(found) * min(len(words), 20) if found else 0.0)
        best = max(range(len(power)), key=lambda k: (power[k], -k))
        return self.langs[best], 1 / sum(math.exp(x - power[best]) for x in power)


def test_languages_against_a_plain_version(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = docs.select("doc_id", "lang", "text").collect()
    plain = PlainLanguages([(r.lang, r.text) for r in rows if r.lang is not None and r.text is not None and crc32(str(r.doc_id).encode()) % 4 != 2])
    got = {r.doc_id: r for r in g.predictions(docs).collect()}
    for r in rows:
        lang, score = plain.predict(r.text)
        assert got[r.doc_id].lang_pred == lang and got[r.doc_id].score == pytest.approx(score, abs=1e-9)
        assert got[r.doc_id].held_out == (crc32(str(r.doc_id).encode()) % 4 == 2)


def test_many_languages(spark):
    word = lambda k: f"word{'abcdefghij'[k % 10] * 3}{'klmnopqrst'[k // 10 % 10] * 3}{'uvw'[k // 100] * 3}"
    rows = [(n, f"{word(n // 4)} {word(n // 4)}", f"l{n // 4:03d}") for n in range(1200)]
    got = g.predictions(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    learned = {lang for n, _, lang in rows if crc32(str(n).encode()) % 4 != 2}
    assert len(learned) > 250 and all(r.lang_pred == f"l{r.doc_id // 4:03d}" for r in got if f"l{r.doc_id // 4:03d}" in learned)


def test_language_edge_rows(spark, docs, rows, no_docs):
    got = g.predictions(docs).collect()
    assert len(got) == len(rows)
    assert {r.doc_id for r in got if r.lang_pred == g.UNKNOWN} == {2, 3, 4}
    assert g.predictions(no_docs).count() == 0
    unlabelled = docs.withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in g.predictions(unlabelled).collect()} == {g.UNKNOWN}
    kept = g.keep_identified(docs)
    assert kept.columns == docs.columns and {2, 3, 4}.isdisjoint(r.doc_id for r in kept.collect())


def test_held_out_labels_are_not_read(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    forged = docs.withColumn("lang", F.when(g.fold(F.col("doc_id"), 4) == 2, "xx").otherwise(F.col("lang")))
    assert g.predictions(forged).where("lang_pred = 'xx'").count() == 0


# --- quality --------------------------------------------------------------------


def test_quality_learns_and_ignores_held_out_labels(spark):
    rng = random.Random(5)
    good = lambda: " ".join(rng.choice(["river", "stone", "walks", "slowly", "under", "trees."]) for _ in range(60))
    bad = lambda: " ".join(rng.choice(["BUY", "NOW!!", "%%%", "CLICK", "$$$"]) for _ in range(60))
    texts = [(k, good() if k % 3 else bad()) for k in range(240)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    labels = spark.createDataFrame([(k, 1 if k % 3 else 0) for k in range(240)], "doc_id long, quality int")
    got = q.classify(docs, labels).toPandas()
    held = got[got["held_out"]]
    assert len(held) > 20 and ((held["doc_id"] % 3 > 0) == (held["predicted"] == 1)).all()
    flipped = labels.withColumn("quality", F.when(q.fold(F.col("doc_id")) == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    assert np.allclose(q.classify(docs, flipped).toPandas().sort_values("doc_id")["score"], got.sort_values("doc_id")["score"])


def test_quality_edge_rows(spark, docs, rows, no_docs):
    labels = spark.createDataFrame([(0, 1), (1, 0), (1, 1), (None, 1), (5, None), (7, 1), (99, 0)], "doc_id long, quality int")
    got = q.classify(docs, labels).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    assert q.classify(no_docs, labels).count() == 0
    none = q.classify(docs, labels.limit(0)).collect()
    assert {r.score for r in none} == {0.5}


def test_feature_pieces_cover_the_text(monkeypatch):
    text = bytes(random.Random(6).choices(b"ab cd\n", k=5000))
    whole = np.sort(np.concatenate(list(q.features(text))))
    monkeypatch.setattr(q, "_PIECE", 64)
    assert np.array_equal(np.sort(np.concatenate(list(q.features(text)))), whole)


def plain_features(text):
    """The same features one at a time: words, pairs, which words of an n-gram stand earlier in it, runs of bytes."""

    def bucket(x, salt):
        x = (x + salt) * 0x9E3779B1 & M32
        x ^= x >> 15
        return (x * 0x85EBCA77 & M32) >> 17

    words = [crc32(w) for w in text.split()]
    if not words:
        return []
    out = [bucket(w, 1) for w in words] + [bucket(a * 31 + b & M32, 2) for a, b in zip(words, words[1:], strict=False)]
    for n in (2, 4, 8):
        for k in range(len(words) - n + 1):
            gram = words[k : k + n]
            out.append(bucket(sum(1 << j for j in range(n - 1) if gram[n - 1 - j] in gram[: n - 1 - j]) + (n << 16), 5))
    for n, salt in ((3, 3), (4, 4)):
        out += [bucket(int.from_bytes(text[k : k + n], "little"), salt) for k in range(len(text) - n + 1)]
    return sorted(out)


def test_quality_against_a_plain_score(spark, sf_dir):
    rng = random.Random(12)
    for n in (0, 1, 2, 3, 9, 400):
        text = bytes(rng.choices(b"abc d e", k=n))
        assert sorted(np.concatenate([np.zeros(0, np.int64), *q.features(text)]).tolist()) == plain_features(text)
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    weights = q.learn(docs, labels, learn_from=q.fold(F.col("id")) != 0).astype(np.float32).astype(float)
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in q.classify(docs, labels).collect():
        found = plain_features((texts[r.doc_id] or "").encode())
        power = [sum(weights[k][c] for k in found) / max(1, len(found)) + weights[-1][c] for c in (0, 1)]
        assert r.score == pytest.approx(1 / (1 + math.exp(power[0] - power[1])), abs=1e-6)


def test_quality_of_held_out_documents(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    got = q.classify(docs, labels).where("held_out").join(labels, "doc_id").toPandas()
    assert len(got) > 60 and (got["predicted"] == got["quality"]).mean() > 0.95


# --- lines ----------------------------------------------------------------------


def masked(line):
    return tuple("<*>" if re.search("[0-9]", w) else w for w in re.findall(r"[^\x20\x09-\x0D]+", line))


def test_exact_templates_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    keeper = {}
    for ident in sorted(texts):
        for line in texts[ident].split("\n"):
            if len(masked(line)) >= ld.MIN_TOKENS:
                keeper.setdefault(masked(line), ident)
    got = {r.doc_id: r.text for r in ld.report(docs).collect()}
    assert got.keys() == texts.keys()
    for ident, text in texts.items():
        left = got[ident].split("\n")
        must = [line for line in text.split("\n") if len(masked(line)) >= ld.MIN_TOKENS and keeper[masked(line)] != ident]
        assert not set(must) & set(left)
        # what else went is like a line of an earlier document
        for line in set(text.split("\n")) - set(left) - set(must):
            w = masked(line)
            assert any(len(o) == len(w) and sum(x == y for x, y in zip(o, w, strict=True)) >= ld.SIMILARITY * len(w) for o, k in keeper.items() if k != ident)


def test_variable_fields(spark):
    lines = [
        "Posted by Alice on the forum of our little town today",
        "Posted by Robert on the forum of our little town today",
        "Posted by Carol on the forum of our big town today",
        "Nothing here is like the other lines at all believe me",
    ]
    docs = spark.createDataFrame([(k, f"own words {k}\n{line}") for k, line in enumerate(lines)], "doc_id long, text string")
    got = {r.doc_id: r.n_dropped for r in ld.report(docs).collect()}
    assert got == {0: 0, 1: 1, 2: 1, 3: 0}


def test_line_edge_rows(docs, rows, no_docs):
    got = ld.report(docs).collect()
    assert len(got) == len(rows)
    by_id = {r.doc_id: r for r in got}
    assert by_id[2].text is None and by_id[3].text == "" and by_id[4].text == "  \t\n "
    assert by_id[0].n_dropped == 0 and by_id[1].text == ""
    assert by_id[9].text == "other\nand a line of its own that stays"
    assert ld.report(no_docs).count() == 0
    clean = ld.clean_documents(docs)
    assert clean.columns == docs.columns
    assert 1 not in {r.doc_id for r in clean.collect()} and {0, 3, 4, 9} <= {r.doc_id for r in clean.collect()}
    assert all(r.n_chars == len(r.text) for r in clean.collect() if r.doc_id == 9)


def alike(a, b):
    return len(a) == len(b) and a[: ld.LEAD] == b[: ld.LEAD] and sum(x == y for x, y in zip(a, b, strict=True)) >= ld.SIMILARITY * len(a)


def kept_lines(texts):
    """What is left of each text: all pairs of a leaf, equal lines for the shorter ones."""
    first, leaves, own = {}, {}, lambda line: masked(line) if len(line.split()) >= ld.MASK_TOKENS else tuple(line.split())
    for ident in sorted(texts):
        for line in texts[ident].split("\n"):
            w = own(line)
            if w and w not in first:
                first[w] = ident
                leaves.setdefault((len(w), w[: ld.LEAD]), []).append(w)
    keeper = {w: None if len(w) > 4 and any(first[o] < first[w] and alike(o, w) for o in leaf) else first[w] for leaf in leaves.values() for w in leaf}
    return {i: "\n".join(x for x in t.split("\n") if not own(x) or keeper[own(x)] == i) for i, t in texts.items()}


def test_all_pairs_of_each_leaf(spark, sf_dir):
    rng = random.Random(4)
    base = ["we met again " + " ".join(rng.choice("abcdefgh") * 3 for _ in range(k)) for k in (2, 2, 3, 7, 12, 12, 17, 22, 40) for _ in range(2)]
    lines = []
    for line in base:
        for _ in range(14):
            words = line.split()
            # every place after the lead may vary, one more at times than may differ
            for at in rng.sample(range(2, len(words)), min(len(words) - 2, rng.randint(1, len(words) // 5 + 1))):
                words[at] = rng.choice(["x", "y", "z"])
            lines.append(" ".join(words))
    rng.shuffle(lines)
    made = [(10**6 + k // 3, "\n".join(lines[k : k + 3])) for k in range(0, len(lines), 3)]
    texts = dict(made) | {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    first, leaves = {}, {}
    for ident in sorted(texts):
        for line in texts[ident].split("\n"):
            w = masked(line)
            if len(w) >= max(4, ld.MIN_TOKENS) and w not in first:
                first[w] = ident
                leaves.setdefault((len(w), w[: ld.LEAD]), []).append(w)
    # a line stays in its first document if no line alike is in an earlier one
    keeper = {w: None if any(first[o] < first[w] and alike(o, w) for o in leaf) else first[w] for leaf in leaves.values() for w in leaf}
    got = {r.doc_id: r.text for r in ld.report(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    for ident, text in texts.items():
        want = [line for line in text.split("\n") if keeper.get(masked(line), ident) == ident and len(masked(line)) >= 4]
        assert [line for line in got[ident].split("\n") if len(masked(line)) >= 4] == want


def test_short_lines(spark):
    texts = ["All rights reserved.\nSpan 12\none", "All  rights reserved.\nSpan 13\n\ntwo", "Span 12\nAll rights deserved.\none\none two three 4\n 12"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id: r.text for r in ld.report(docs).collect()} == {0: texts[0], 1: "Span 13\n\ntwo", 2: "All rights deserved.\none two three 4\n 12"}


def test_documents_without_id(spark):
    a, b = "a line that only they share\nfirst", "a line that only they share\nsecond"
    docs = spark.createDataFrame([(None, a), (None, b), (None, b), (None, None), (None, None), (None, " \n"), (None, " \n"), (2**63 - 1, "and one of the last\nx"), (None, "and one of the last")], "doc_id long, text string")
    got = [r.text for r in ld.report(docs).collect()]
    # each line stays once; the repeated row loses all
    assert sorted(x for t in got if t and t.strip() for x in t.split("\n")) == sorted(["a line that only they share", "first", "second", "and one of the last", "x"])
    assert len(got) == 9 and got.count(None) == 2 and got.count(" \n") == 2 and "and one of the last\nx" in got
    near = spark.createDataFrame([(None, "one of these five"), (None, "one of these five words"), (None, "one of these six words")], "doc_id long, text string")
    assert sorted(r.n_dropped for r in ld.report(near).collect()) == [0, 0, 1]


def test_lines_alike_only_to_each_other(spark):
    """Pairs that share their first six words with all others and agree in ten tokens of twelve."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choices("abcdefghijklmnop", k=7))
    texts = []
    for k in range(50):
        tail = [word() for _ in range(6)]
        for _ in range(2):
            own = list(tail)
            for at in rng.sample(range(6), 1):
                own[at] = word()
            texts.append("all of these lines begin alike " + " ".join(own))
    got = ld.report(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {r.doc_id for r in got if r.n_dropped} == set(range(1, 100, 2))


def test_lines_of_string_ids_and_odd_columns(spark):
    df = spark.createDataFrame([("b", "one line here\nmine", 1, {"x": 1}), ("a", "one line here\nalso mine", 2, {"y": 2}), (None, "one line here", 3, None)], "doc_id string, text string, `a.b` int, m map<string,int>")
    assert {r.doc_id: r.text for r in ld.report(df).collect()} == {"a": "one line here\nalso mine", "b": "mine", None: ""}
    clean = ld.clean_documents(df)
    assert clean.columns == df.columns and {tuple(r)[:3] for r in clean.collect()} == {("a", "one line here\nalso mine", 2), ("b", "mine", 1)}


def test_a_text_of_many_lines(spark):
    lines = [f"line of words {'abcdefghij'[k % 10]}{'klmnopqrst'[k // 10 % 10]}{'uvwxyz'[k // 100 % 6]}{'abcdefghi'[k // 600 % 9]}" for k in range(5000)]
    df = spark.createDataFrame([(1, "\n".join(lines)), (2, "\n".join([*lines, "one more"]))], "doc_id long, text string")
    got = {r.doc_id: r for r in ld.report(df).collect()}
    assert got[2].text == "one more" and got[2].n_dropped == 5000


# --- pages ----------------------------------------------------------------------


def test_blocks():
    page = html_blocks.blocks("<body><nav><a href=x>Home</a></nav><p>a&amp;b <b>c</b>\n d<br>e<p>next<script>x</script></body><!-- c --> tail")
    assert [b.text for b in page] == ["Home", "a&b c d e", "next", "tail"]
    assert page[0].link == 1 and page[0].path[-1][0] == "nav"
    assert html_blocks.blocks(None) == [] and html_blocks.blocks("<p") == []
    assert [b.text for b in html_blocks.blocks("<ul><li>one<li>two</ul><div class='x' title=\"a>b\">three")] == ["one", "two", "three"]
    assert [b.text for b in html_blocks.blocks("<script>never closed <p>x")] == []


def test_elements_without_end_hide_nothing():
    texts = lambda x: [b.text for b in html_blocks.blocks(x)]
    assert texts('<p>a <svg width="1"/> b<p>c <svg class=x/><text>no</text></svg> d') == ["a b", "c d"]
    assert texts("<p>a <svg /> b <svg><text>no</text></svg> c") == ["a b c"]
    assert texts("<p>a <object data=x> b<p>c") == ["a b", "c"] and texts("<p>a <object data=x>or this</object> b") == ["a or this b"]
    assert texts("<p>x<!-->y</p><p>z</p>") == texts("<p>x<!--->y</p><p>z</p>") == ["xy", "z"]
    assert texts("<p>x<!-- > --!>y<!-- -- > <p>--><!---->z<!----!>") == ["xyz"] and texts("<p>x<!-- y") == ["x"]
    assert texts("<p>so <math><mi>x</mi><mo>=</mo><mn>2</mn><annotation>x=2</annotation></math> holds<p>e <math/> f") == ["so x=2 holds", "e f"]


@pytest.mark.parametrize("unit", ['<a "', "<b ", '<a x=">"', "<b<b", "<div>x", "<svg>", "<header><li>", "</p></div>", "<", "<!--", "<script", "<a '\"", "<nav class='a b'>x", "<form>|<td></td>", "<p>|<li></li>", "<!-- --!>", "<!-->", "<div><form>|</form>"])
def test_pages_are_read_in_linear_time(unit):
    """A megabyte of what never ends, against a tenth of it."""
    took = []
    for n in (100_000, 1_000_000):
        first, _, second = unit.partition("|")
        page = ("<td><div>" + "".join(x * (n // 2 // len(x)) for x in (first, second)) if second else unit * (n // len(unit)))
        begin = time.process_time()
        html_blocks.blocks(page)
        took.append(time.process_time() - begin)
    assert took[1] < 40 * took[0] + 2


def test_a_page_inside_one_form():
    page = f"<body><form id='aspnetForm'><nav><a href=/>Home</a></nav><article><h1>A title of some words</h1><p>{'Words of an article that go on for a while. ' * 4}</p></article><footer>(c) us</footer></form></body>"
    got = html_extract.main_texts([page], html_extract.trained())[0]
    assert got.startswith("A title of some words\nWords of an article") and "Home" not in got and "(c)" not in got


def test_long_pages_are_projected_in_pieces(monkeypatch):
    rng = random.Random(21)
    page = html_blocks.blocks("".join(html_extract.synthetic_page(rng) for _ in range(30)))
    model = html_extract.trained()
    want = model.label([html_blocks.vectors(page)])[0]
    monkeypatch.setattr(html_extract, "PIECE", 50)
    assert np.array_equal(model.label_blocks([page])[0], want)


def test_gradients():
    rng = random.Random(3)
    pages = [html_extract.labelled(html_extract.synthetic_page(rng)) for _ in range(3)]
    model = html_extract.Labeller(5)
    model.w = {k: v.astype(np.float64) for k, v in model.w.items()}
    x, mask = html_extract._padded([html_blocks.vectors(p) for p, _ in pages])
    y = np.zeros_like(mask)
    for k, (_, t) in enumerate(pages):
        y[: len(t), k] = t
    _, grads = model.gradients(x, mask, y)
    for name, grad in grads.items():
        at = np.unravel_index(np.abs(grad).argmax(), grad.shape)
        sides = []
        for step in (1e-4, -2e-4):
            model.w[name][at] += step
            sides.append(model.gradients(x, mask, y)[0])
        model.w[name][at] += 1e-4
        assert grad[at] == pytest.approx((sides[0] - sides[1]) / 2e-4, rel=1e-3, abs=1e-6)


def test_main_text_of_pages(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    odd = spark.createDataFrame([(9001, None, None), (9002, "u", ""), (9002, "u", ""), (None, "u", "<nav>x</nav>")], "page_id long, url string, html string")
    got = html_extract.extract(pages.unionByName(odd).withColumn("text", F.lit("clash"))).collect()
    assert len(got) == pages.count() + 4
    by_id = {r.page_id: r.text for r in got}
    assert by_id[9001] == by_id[9002] == by_id[None] == ""
    right = 0
    for r in pages.collect():
        body = re.search(r"<article>(.*)</article>", r.html, re.S)[1]
        parts = re.split(r"</?(?:p|h1)>", body)
        want = "\n".join(t for t in (" ".join(html.unescape(re.sub("<[^>]*>", "", p.replace("<br>", " "))).split()) for p in parts) if t)
        right += by_id[r.page_id] == want
    assert right >= 0.98 * pages.count()
    assert html_extract.extract(pages.limit(0)).count() == 0


def test_labels_of_unseen_layouts():
    rng, right, n = random.Random(77), 0, 0
    for _ in range(80):
        page, y = html_extract.labelled(html_extract.synthetic_page(rng))
        if page:
            right += (html_extract.trained().label([html_blocks.vectors(page)])[0] == y).sum()
            n += len(y)
    assert right / n > 0.98


def test_batching_does_not_change_labels():
    rng = random.Random(8)
    pages = [html_blocks.vectors(html_extract.labelled(html_extract.synthetic_page(rng))[0]) for _ in range(20)]
    model = html_extract.trained()
    together = model.label(pages)
    assert all(np.array_equal(a, model.label([p])[0]) for a, p in zip(together, pages, strict=True))
