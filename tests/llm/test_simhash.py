import random
import re

import numpy as np
import xxhash
from pyspark.sql import functions as F

from tallyspark.llm import simhash_dedup as s
from tallyspark.llm.common import components


def fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c < "\x80" else c for c in text or ""))
    sh = [" ".join(w[k : k + 3]) for k in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def classes(prints, budget=2):
    """Smallest id reachable, by comparing all pairs."""
    parent = list(range(len(prints)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(prints)):
        for b in range(a):
            if (prints[a][1] ^ prints[b][1]).bit_count() <= budget:
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    low = {}
    for k, (ident, _) in enumerate(prints):
        if ident is not None:
            low[root(k)] = min(low.get(root(k), ident), ident)
    return [low.get(root(k)) for k in range(len(prints))]


def test_against_brute_force(docs, rows):
    prints = [(r[0], fingerprint(r[1])) for r in rows]
    want = sorted(zip([p[0] for p in prints], [f"{p[1]:016x}" for p in prints], classes(prints), strict=True), key=repr)
    assert sorted(map(tuple, s.near_duplicates(docs).collect()), key=repr) == want


def test_native_hash_agrees(spark):
    assert spark.sql("SELECT xxhash64('a b c') AS h").first().h == np.uint64(xxhash.xxh64_intdigest(b"a b c", 42)).astype(np.int64)


def test_links_at_the_limit_and_hot_groups(spark):
    rng = random.Random(1)
    prints = set()
    for _ in range(40):
        centre = rng.getrandbits(64)
        prints.add(centre)
        for _ in range(12):
            x = centre
            for b in rng.sample(range(64), rng.choice([1, 2, 2, 3])):
                x ^= 1 << b
            prints.add(x)
    # a dense cluster: one group of the join holds most of it
    base = rng.getrandbits(64)
    prints |= {base ^ k for k in range(300)}
    prints = sorted(prints)
    ids = list(enumerate(prints))
    want = classes(ids)
    df = spark.createDataFrame([(int(np.uint64(p).astype(np.int64)),) for p in prints], "fp long")
    place = {int(np.uint64(p).astype(np.int64)): k for k, p in ids}
    for hot in (s.HOT_GROUP, 20):
        links = [(place[r.u], place[r.v]) for r in s.fingerprint_links(df, hot_group=hot).collect()]
        parent = list(range(len(prints)))

        def root(x, parent=parent):
            while parent[x] != x:
                x = parent[x]
            return x

        for a, b in links:
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
        assert [root(k) for k in range(len(prints))] == want
        assert len(links) <= 6 * len(prints) * 37


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(60)] + [(100, 101), (5, 5)], "u long, v long")
    got = {r.u: r.root for r in components(edges).collect()}
    assert got == {**{k: 0 for k in range(1, 61)}, 101: 100}


def test_one_document_of_each_class_stays(docs, no_docs):
    kept = s.keep_representatives(docs)
    assert kept.columns == docs.columns
    # 0 and both rows of 1 are one class; 2, 3 and 4 have no words
    assert sorted(r.doc_id for r in kept.where(F.col("doc_id").isNotNull()).collect()) == [0, 2, 5, 6, 7, 8, 9, 10]
    assert s.near_duplicates(no_docs).count() == 0
    assert s.keep_representatives(no_docs).count() == 0


def test_repeated_rows_leave_one(spark):
    df = spark.createDataFrame([(1, "same text of words")] * 5, "doc_id long, text string")
    assert s.keep_representatives(df).count() == 1


def test_representatives_are_rows(spark):
    texts = ["one text of a few words", "quite another text with words", "and a third that is like none"]
    df = spark.createDataFrame([(i, t) for t in texts for i in (None, None)] + [(7, "some text under seven"), (7, "not the same under seven at all"), (8, "some text under seven")], "doc_id long, text string")
    got = sorted(((r.doc_id or 0, r.text) for r in s.keep_representatives(df).collect()))
    assert got == sorted([(0, t) for t in texts] + [(7, "some text under seven"), (7, "not the same under seven at all")])


def shingles(text, n=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c < "\x80" else c for c in text or ""))
    return frozenset(tuple(w[k : k + n]) for k in range(len(w) - n + 1)) or frozenset([tuple(w)] if w else [])


def similar_classes(rows, limit=0.8):
    """Smallest row that each row reaches, over all pairs of texts with enough shingles in common."""
    sets, holders, parent = [shingles(t) for _, t in rows], {}, list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, own in enumerate(sets):
        common = {}
        for x in own or ["none"]:
            for j in holders.setdefault(x, []):
                common[j] = common.get(j, 0) + 1
            holders[x].append(k)
        for j, both in common.items():
            if not own or both >= limit * (len(own) + len(sets[j]) - both):
                a, b = root(j), root(k)
                parent[max(a, b)] = min(a, b)
    return [root(k) for k in range(len(rows))]


def edited_copies(rng, base, n, share):
    out = []
    for _ in range(n):
        words = base.split()
        for at in rng.sample(range(len(words)), max(1, int(share * len(words)))):
            words[at] = f"x{rng.randrange(10**6)}"
        out.append(" ".join(words))
    return out


def test_similar_texts_against_brute_force(spark):
    rng = random.Random(3)
    texts = []
    for share in (0.002, 0.01, 0.02, 0.021, 0.022, 0.03):
        for _ in range(20):
            base = " ".join(f"w{rng.randrange(3000)}" for _ in range(rng.choice([60, 200, 600])))
            texts += [base, *edited_copies(rng, base, 3, share)]
    texts += ["", None, " ", "one two", "one two", "One  two", "three"]
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = {k for k, r in enumerate(similar_classes(rows)) if r == k}
    for crowd in (s.CROWD, 2):
        got = {r.doc_id for r in s.keep_representatives(df, crowd=crowd).collect()}
        # links are confirmed exactly, so nothing goes that brute force keeps
        assert want <= got
        assert len(texts) - len(got) >= 0.97 * (len(texts) - len(want))


def test_a_crowd_of_near_copies(spark):
    rng = random.Random(4)
    base = " ".join(f"w{rng.randrange(3000)}" for _ in range(300))
    df = spark.createDataFrame(list(enumerate(edited_copies(rng, base, 600, 0.005))), "doc_id long, text string")
    assert [r.doc_id for r in s.keep_representatives(df, crowd=32).collect()] == [0]


def test_recall_of_the_bands():
    for n in (1_000, 10**7, 10**10):
        width, count = s.bands(n)
        agree = (1 - np.arccos(1.6 / 1.8) / np.pi) ** width
        assert 1 - (1 - agree) ** count >= s.RECALL and 2**width * 512 >= n


def test_columns_of_any_name_and_type(spark):
    df = spark.createDataFrame([(1, "same text", 1, {"k": 1}), (1, "same text", 1, {"k": 1}), (2, "Same  text", 2, None)], "doc_id long, text string, `a.b` int, m map<string,int>")
    got = s.keep_representatives(df)
    assert got.columns == df.columns and [tuple(r)[:3] for r in got.collect()] == [(1, "same text", 1)]


def test_components_of_a_large_star(spark):
    edges = spark.createDataFrame([(k, 0) for k in range(1, 3001)] + [(5000, k) for k in range(1, 3001)], "u long, v long")
    got = {r.u: r.root for r in components(edges).collect()}
    assert got == {k: 0 for k in [*range(1, 3001), 5000]}
