"""What near-duplicates ask of the driver: jobs by rounds, and no texts in what it broadcasts."""

from tallyspark.llm import common
from tallyspark.llm import simhash_dedup as s


def test_stars_take_no_round(spark, monkeypatch):
    written = []
    stored = common.stored
    monkeypatch.setattr(common, "stored", lambda df, label: written.append(label) or stored(df, label))
    stars = spark.createDataFrame([(k, k % 7) for k in range(7, 400)] + [(3, 3), (10, 3)], "u long, v long")
    assert {r.u: r.root for r in common.components(stars).collect()} == {k: k % 7 for k in range(7, 400)}
    # the edges and one grouped pass
    assert len(written) == 2
    assert common.components(stars.limit(0)).count() == 0


def test_few_keys_and_even_ones_are_joined_as_others(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT_KEYS", 10)
    for counts in ([0], [5, 1, 1], [3] * 40, [200, *[1] * 40]):
        rows = spark.createDataFrame([(k, i) for k, n in enumerate(counts) for i in range(n)], "k long, i long")
        sizes = spark.createDataFrame([(k, n, -k) for k, n in enumerate(counts) if n], "k long, n long, x long")
        marks = sizes.agg(*common.size_marks()).first()
        want = sorted((k, i, n, -k) for k, n in enumerate(counts) for i in range(n))
        assert sorted(map(tuple, common.spread_join(rows, sizes, "k", marks=marks).collect())) == want
        assert sorted(map(tuple, common.spread_join(rows, sizes, "k").collect())) == want


def test_a_text_of_many_partners_is_not_broadcast(spark, monkeypatch):
    asked = []
    spread = s.spread_join

    def watched(rows, sizes, *rest, **more):
        asked.extend(f.dataType.simpleString() for f in sizes.schema.fields)
        return spread(rows, sizes, *rest, **more)

    monkeypatch.setattr(s, "spread_join", watched)
    monkeypatch.setattr(s, "PARTNERS", 4, raising=False)
    # text 0 is similar to each of the others by name, to half of them in fact
    bodies = [" ".join(f"w{i}" for i in range(60))] + [" ".join(f"w{i}" if i < 58 or k % 2 else f"x{k}-{i}" for i in range(60 if k % 2 else 90)) for k in range(1, 41)]
    texts = spark.createDataFrame([(k, bytearray(b, "utf8")) for k, b in enumerate(bodies)], "fp long, body binary")
    pairs = spark.createDataFrame([(k, 0, 0.1) for k in range(1, 41)], "u long, v long, far double")
    links = s.confirmed_links(pairs, texts, s.WORDS, s.SIMILARITY)
    assert {(r[0], r[1]) for r in links.collect()} == {(k, 0) for k in range(1, 41, 2)}
    assert asked and not {"string", "binary"} & set(asked)
