"""Merkle manifest of a dataset by an associative sparse-forest monoid.

Each row is a leaf: SHA-256 of its fields, every one written as its length in UTF-8
bytes, a colon and its value, or ``-`` for null. Per source, leaves ascend by doc_id;
every ``ARITY`` consecutive nodes of a level (the last run may be shorter) become the
hash of their hex digests, up to one subroot. The subroots, in the order of their
sources, make the top tree and its root.

A *fragment* is a sparse forest: the nodes whose parent can't be computed yet, keyed by
tree, level and index. The sizes of the trees are known, hence the members of every run;
``merge`` unites fragments and hashes each run that is complete, so it is associative
and commutative and a fragment of a contiguous piece holds a few nodes a level only.
Each range of rows gives one fragment; ``treeReduce`` merges them to the root. The same
merge in rounds of ``FAN`` ranges writes the nodes formed between ranges down, which the
proofs need: every range gets the siblings on the paths of its own rows by an equi-join.

Rows are range-partitioned by source, doc_id, digest and a row number, so a source of a
third of all rows lies in many ranges; texts stay where they are, only digests are
shuffled. The driver sees one row for each range and the merged fragment.

Edge cases: a null source comes first, a null doc_id first in its source; rows that are
equal in source and doc_id go by their digests, whole copies are interchangeable; a very
long text is one field, hashed as a whole; other columns are ignored unless named in
``fields``; a source of one row is its own leaf, a table of one source has its subroot as
root; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import partitions, quoted, stored

ARITY = 3
#: Ranges whose fragments one task merges in a round.
FAN = 16
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: The tree of subroots.
TOP = -1

Node = tuple[int, int, int]
Fragment = dict[Node, str]
Levels = list[tuple[int, list[str]]]


def digest(*parts: str) -> str:
    return sha256("".join(parts).encode()).hexdigest()


def leaf_hash(fields: Iterable[Column]) -> Column:
    """A row's leaf from its fields."""
    texts = [f.cast("string") for f in fields]
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts)), 256)


def parents(n: int) -> int:
    return -(-n // ARITY)


def climb(first: int, nodes: list[str], n: int) -> Levels:
    """For each level its first index and digests, from consecutive nodes of a level of ``n``."""
    levels = [(first, nodes)]
    while n > 1 and nodes:
        end = first + len(nodes)
        low, high = parents(first), parents(n) if end == n else end // ARITY
        nodes = [digest(*nodes[ARITY * r - first : ARITY * r + ARITY - first]) for r in range(low, high)]
        first, n = low, parents(n)
        levels.append((first, nodes))
    return levels


def merge(a: Fragment, b: Fragment, sizes: dict[int, int], formed: Fragment | None = None) -> Fragment:
    """The union of two fragments with every complete run hashed; ``formed`` gets the new nodes."""
    loose = a | b
    # the top tree after the others, whose roots are its leaves; each tree from below
    for start in sorted(loose, key=lambda k: (k[0] == TOP, k)):
        tree, level, index = start
        n = sizes[tree]
        for _ in range(level):
            n = parents(n)
        while (tree, level, index) in loose:
            if n == 1:
                if tree == TOP:
                    break
                made = (TOP, 0, tree)
                value = loose.pop((tree, level, index))
                n = sizes[TOP]
            else:
                run = index // ARITY
                members = [(tree, level, i) for i in range(ARITY * run, min(ARITY * run + ARITY, n))]
                if any(m not in loose for m in members):
                    break
                made = (tree, level + 1, run)
                value = digest(*(loose.pop(m) for m in members))
                n = parents(n)
            loose[made] = value
            if formed is not None:
                formed[made] = value
            tree, level, index = made
    return loose


def _ranged(leaves: DataFrame) -> DataFrame:
    """``leaves`` in order: ``at`` holds the range and the place in it."""
    order = [F.col("source").asc_nulls_first(), F.col("id").asc_nulls_first(), F.col("leaf"), F.col("row")]
    n = partitions(leaves.sparkSession)
    return stored(leaves.repartitionByRange(n, *order).sortWithinPartitions(*order).drop("row").withColumn("at", F.monotonically_increasing_id()), "leaves")


def _range(at: str = "at") -> Column:
    return F.shiftright(at, 33)


def _segments(rows: DataFrame) -> DataFrame:
    """A row for each range and source: number of the source, rows here, before and in all, and of sources in all."""
    spark = rows.sparkSession
    parts = stored(rows.groupBy(_range().alias("part"), "source").agg(F.min("at").alias("at"), F.count(F.lit(1)).alias("m")), "segments")
    # a source has a row for each range at most here
    of_source = Window.partitionBy("source")
    parts = parts.withColumn("begins", F.col("at") == F.min("at").over(of_source)).withColumn("n", F.sum("m").over(of_source))
    parts = parts.withColumn("before", F.coalesce(F.sum("m").over(of_source.orderBy("at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    here = Window.partitionBy("part").orderBy("at")
    parts = stored(parts.withColumn("nth", F.count_if("begins").over(here)), "segments")
    # a row for each range
    begun, rows_of = 0, []
    for part, k in sorted(tuple(r) for r in parts.groupBy("part").agg(F.count_if("begins")).collect()):
        rows_of.append((part, begun))
        begun += k
    bases = spark.createDataFrame(rows_of, "part long, base long")
    # a source that began in an earlier range is the last of those begun before
    return stored(parts.join(bases, "part").select("part", (F.col("base") + F.col("nth") - 1).alias("tree"), "at", "m", "n", "before", F.lit(begun).cast("long").alias("sources")), "segments")


def _grown(rows: pa.Table, segments: pa.Table) -> tuple[dict[int, Levels], dict[int, tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Levels of each tree that the range's rows give, span and size of each tree here, and (tree, first row, rows) of each segment."""
    leaves = rows["leaf"].to_pylist()
    trees: dict[int, Levels] = {}
    spans: dict[int, tuple[int, int, int]] = {}
    places, begin, whole = [], 0, []
    for s in sorted(segments.to_pylist(), key=lambda s: s["tree"]):
        tree, m, n, before = s["tree"], s["m"], s["n"], s["before"]
        trees[tree] = climb(before, leaves[begin : begin + m], n)
        spans[tree] = (before, before + m - 1, n)
        if m == n:
            whole.append((tree, trees[tree][-1][1][0]))
        places.append((tree, begin, m))
        begin += m
    if places:
        spans[TOP] = (places[0][0], places[-1][0], segments["sources"][0].as_py())
        trees[TOP] = climb(whole[0][0] if whole else spans[TOP][0], [d for _, d in whole], spans[TOP][2])
    return trees, spans, places


def _loose(trees: dict[int, Levels], spans: dict[int, tuple[int, int, int]]) -> Iterator[tuple[Node, str]]:
    """The nodes of a range without parent here."""
    for tree, levels in trees.items():
        n = spans[tree][2]
        for level, (first, nodes) in enumerate(levels):
            low, up = levels[level + 1] if level + 1 < len(levels) else (0, [])
            if n == 1 and tree != TOP:
                break
            for i, value in enumerate(nodes, first):
                if not low <= i // ARITY < low + len(up):
                    yield (tree, level, i), value
            n = parents(n)


def _wanted(trees: dict[int, Levels], spans: dict[int, tuple[int, int, int]]) -> Iterator[Node]:
    """The nodes on and beside the paths of a range's rows that it can't compute itself."""
    for tree, (low, high, n) in spans.items():
        for level in range(64):
            first, nodes = trees[tree][level] if level < len(trees[tree]) else (0, [])
            whole = n == 1
            for i in range(low if whole else low // ARITY * ARITY, 1 if whole else min(high // ARITY * ARITY + ARITY, n)):
                if not first <= i < first + len(nodes) and (tree == TOP or not whole):
                    yield tree, level, i
            if whole:
                break
            low, high, n = low // ARITY, high // ARITY, parents(n)


NODE = "part long, tree long, level int, idx long, n long, value string"
NODES = pa.schema([("part", pa.int64()), ("tree", pa.int64()), ("level", pa.int32()), ("idx", pa.int64()), ("n", pa.int64()), ("value", pa.string())])


def _table(rows: list[tuple]) -> pa.Table:
    return pa.table(list(zip(*rows, strict=True)) or [[]] * len(NODES), schema=NODES)


def _fragment(rows: pa.Table, segments: pa.Table) -> pa.Table:
    """Loose nodes of a range; wanted ones have no value."""
    trees, spans, _ = _grown(rows.sort_by("at"), segments)
    part = segments["part"][0].as_py()
    out = [(part, *node, spans[node[0]][2], value) for node, value in _loose(trees, spans)]
    return _table(out + [(part, *node, spans[node[0]][2], None) for node in _wanted(trees, spans)])


def _as_fragment(rows: Iterable) -> tuple[Fragment, dict[int, int]]:
    nodes, sizes = {}, {}
    for r in rows:
        nodes[(r["tree"], r["level"], r["idx"])] = r["value"]
        sizes[r["tree"]] = r["n"]
    return nodes, sizes


def _merged(sources: int):
    """Merges the fragments of neighbouring ranges; negative ``n`` marks nodes formed here that are not loose any more."""

    def run(rows: pa.Table) -> pa.Table:
        nodes, sizes = _as_fragment(rows.to_pylist())
        part = rows["part"][0].as_py() // FAN
        formed: Fragment = {}
        sizes[TOP] = sources
        loose = merge(nodes, {}, sizes, formed)
        out = [(part, *k, sizes[k[0]], v) for k, v in loose.items()]
        return _table(out + [(-1, *k, sizes[k[0]], v) for k, v in formed.items()])

    return run


def _root(loose: DataFrame, sources: int) -> str:
    """The root, by ``treeReduce`` over the fragments."""

    def gather(rows: Iterable) -> Iterator[tuple[Fragment, dict[int, int]]]:
        nodes, sizes = _as_fragment(rows)
        sizes[TOP] = sources
        yield merge(nodes, {}, sizes), sizes

    def unite(a: tuple[Fragment, dict[int, int]], b: tuple[Fragment, dict[int, int]]) -> tuple[Fragment, dict[int, int]]:
        sizes = a[1] | b[1]
        loose = merge(a[0], b[0], sizes)
        return loose, {t: sizes[t] for t in {k[0] for k in loose} | {TOP}}

    (root,) = loose.rdd.mapPartitions(gather).treeReduce(unite, 3)[0].values()
    return root


class _Path:
    """Siblings on the way from a node up; ``text`` is all of them in order."""

    __slots__ = ("left", "right", "above", "text")

    def __init__(self, left: str, right: str, above: _Path | None):
        self.left, self.right, self.above = left, right, above
        self.text = left + right + (above.text if above else "")

    def fold(self, value: str) -> str:
        at: _Path | None = self
        while at:
            value = digest(at.left, value, at.right)
            at = at.above
        return value


def _paths(levels: Levels, known: Fragment, tree: int, n: int, above: _Path | None):
    """A function from an index of the tree's lowest level to its path, quick for ascending indices."""
    sizes = [n]
    while sizes[-1] > 1:
        sizes.append(parents(sizes[-1]))
    last: list[tuple[int, _Path | None]] = [(-1, None)] * len(sizes)

    def value(level: int, i: int) -> str:
        first, nodes = levels[level] if level < len(levels) else (0, [])
        return nodes[i - first] if first <= i < first + len(nodes) else known[(tree, level, i)]

    def path(i: int, level: int = 0) -> _Path | None:
        if sizes[level] == 1:
            return above
        if last[level][0] != i:
            run = i // ARITY * ARITY
            left = "".join(value(level, j) for j in range(run, i))
            right = "".join(value(level, j) for j in range(i + 1, min(run + ARITY, sizes[level])))
            last[level] = (i, _Path(left, right, path(i // ARITY, level + 1)))
        return last[level][1]

    return path, value


def _proofs(rows: pa.Table, side: pa.Table) -> pa.Table:
    """The rows of a range with subroot, proof and folded root. ``side``: its segments, and the nodes it can't compute."""
    rows, is_node = rows.sort_by("at"), side["value"].is_valid()
    segments = side.filter(pa.compute.invert(is_node))
    trees, spans, places = _grown(rows, segments)
    known, _ = _as_fragment(side.filter(is_node).to_pylist())
    top_path, top_value = _paths(trees[TOP], known, TOP, spans[TOP][2], None)
    subroots, proofs, folded = [], [], []
    leaves, others = rows["leaf"].to_pylist(), rows["other"].to_pylist()
    for tree, begin, m in places:
        path, _ = _paths(trees[tree], known, tree, spans[tree][2], top_path(tree))
        subroot = top_value(0, tree)
        for k in range(m):
            way = path(spans[tree][0] + k)
            leaf = leaves[begin + k] if others[begin + k] is None else others[begin + k]
            subroots.append(subroot)
            proofs.append(digest(way.text) if way else digest())
            folded.append(way.fold(leaf) if way else leaf)
    made = {"id": rows["id"], "leaf": rows["leaf"], "other": rows["other"], "subroot": pa.array(subroots, pa.string()), "proof_sha256": pa.array(proofs, pa.string()), "folded_root": pa.array(folded, pa.string())}
    return pa.table(made)


def manifest(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", fields: Iterable[str] = FIELDS, presented: Column | None = None) -> DataFrame:
    """One row per row of ``docs``: id, leaf, subroot, root, proof_sha256, folded_root, verified.

    ``presented`` is the leaf that a holder of the data presents (null: the row's own);
    ``folded_root`` is computed from it and the row's siblings, ``verified`` says whether it is the root.
    """
    ident = F.col(quoted(id_col))
    leaf = leaf_hash(F.col(quoted(f)) for f in fields)
    other = F.lit(None).cast("string") if presented is None else presented
    rows = _ranged(stored(docs.select(ident.alias("id"), F.col(quoted(source_col)).alias("source"), leaf.alias("leaf"), other.alias("other"), F.monotonically_increasing_id().alias("row")), "rows"))
    segments = _segments(rows)
    sources = (segments.agg(F.max("sources")).first()[0]) or 0
    keyed = rows.withColumn("part", _range())
    first = stored(keyed.select("part", "at", "leaf").groupBy("part").cogroup(segments.groupBy("part")).applyInArrow(_fragment, NODE), "fragments")
    loose, wanted = first.where("value IS NOT NULL"), first.where("value IS NULL")
    nodes, now, blocks = [loose], loose, (rows.agg(F.max(_range())).first()[0] or 0) + 1
    root = _root(loose, sources) if sources else None
    while blocks > 1:
        merged = stored(now.groupBy(F.expr(f"part DIV {FAN}")).applyInArrow(_merged(sources), NODE), "fragments")
        now, blocks = merged.where("part >= 0"), parents_of(blocks)
        nodes.append(merged.where("part < 0"))
    every = reduce(DataFrame.unionByName, nodes).select("tree", "level", "idx", F.col("value"))
    found = wanted.drop("value").join(every, ["tree", "level", "idx"])
    blank = {c: F.lit(None).cast("long").alias(c) for c in ("at", "m", "before", "sources")}
    side = found.select("part", "tree", "level", "idx", "n", "value", *blank.values()).unionByName(segments, allowMissingColumns=True)
    kind = dict(rows.dtypes)["id"]
    proven = keyed.select("part", "at", "id", "leaf", "other").groupBy("part").cogroup(side.groupBy("part")).applyInArrow(_proofs, f"id {kind}, leaf string, other string, subroot string, proof_sha256 string, folded_root string")
    root_col = F.lit(root).cast("string")
    return proven.select(F.col("id").alias(id_col), "leaf", "subroot", root_col.alias("root"), "proof_sha256", "folded_root", (F.col("folded_root") == root_col).alias("verified"))


def parents_of(blocks: int) -> int:
    """Blocks after a round of merging."""
    return -(-blocks // FAN)


def tampered(docs: DataFrame) -> Column:
    """The leaf without the line ends of the text, for rows whose id has an even CRC-32; null for others."""
    fields = [F.regexp_replace("text", "\n", "") if f == "text" else F.col(f) for f in FIELDS]
    return F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, leaf_hash(fields))


def report(docs: DataFrame) -> DataFrame:
    """The manifest of ``docs`` and what each row proves after tampering with every second one."""
    return manifest(docs, presented=tampered(docs))
