"""Line dedup by a log-template tree, in DataFrame functions only.

The tree has a fixed depth: a line goes down by its number of tokens, then by its
``LEAD`` leading tokens, with every token that holds a digit read as a variable
field. A leaf's lines that read the same are one template. To generalise other
variable fields, two lines of a leaf are alike if at least ``SIMILARITY`` of their
tokens agree, place by place. Lines of under ``MASK_TOKENS`` tokens are read as they
are, digits included: with one field of three tokens they are not alike.

A line that occurs in two documents or more stays in the one of smallest id only,
and there only if no line alike occurs in a document before it. So each line that
goes has its like in an earlier document. Repeats within the document that keeps
a line stay.

Only leaves of two different lines or more are looked into. There all alike pairs
share a key. Where one token may differ, a line's keys are the line
without each one of its tokens after the lead; where k may differ, the tokens after
the lead are cut into k + 1 runs, one of which is whole in both lines. A line is
compared with the first line of each of its keys, which settles all lines of a group
of like ones. Keys of more than ``WIDE`` lines with as many still open are made longer once: the
tokens that they leave out are cut into runs in turn, one of which is whole in alike lines, so
lines that are alike in one run only part. With few open lines these are compared with all of the
key. What is left is ranked within its keys by first document and compared with those
before it, best first, in rounds of growing reach (by ``REACH``), until one is alike. No pair of
alike lines of a leaf is missed.

Only hashes of lines are shuffled for the counts, pre-aggregated by template; texts
of lines are fetched once for leaves in question. Lines, leaves, keys and first
lines with very many rows are joined by broadcast (``spread_join``), never gathered.
The texts are shuffled once more, to meet the list of their dropped lines.

What goes is lost: a line that differs from an earlier one in its numbers or in a
fifth of its tokens only is a repeat of a template and is dropped with what it says.

Edge cases: null texts have no lines and stay null; a very long text is cut into lines, a
very long line of n tokens has up to n / 5 + 1 keys; blank lines stay; a null
doc_id orders after all others, and rows without one are documents of their own;
rows with one doc_id count as one document; ids may be of any type with an order; an
empty table gives an empty result; other columns pass through untouched, whatever
their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import let, own, spread_join, stored

MIN_TOKENS = 1
MASK_TOKENS = 4  # in a shorter line a variable field is over the limit
LEAD = 2
SIMILARITY = 0.8
REACH = 8
#: Leaves of several lines up to which a table of them goes to all executors.
BROADCAST_LEAVES = 1_000_000
#: Open lines of a key up to which they are compared with all others; keys of more are made longer.
WIDE = 512
#: A token that holds a digit; each place is tried once only.
_FIELD = r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9]*+[0-9][^\x20\x09-\x0D]*+"
_BLANK = r"[\x20\x09-\x0D]+"
#: A digit, and as many tokens as a line with fields has.
_DIGIT = "[0-9]"
_MASKABLE = rf"^[\x20\x09-\x0D]*+(?:[^\x20\x09-\x0D]++[\x20\x09-\x0D]++){{{MASK_TOKENS - 1}}}[^\x20\x09-\x0D]"
#: A line in which blanks aren't single spaces between tokens.
_UNEVEN = r"[\x09-\x0D]|\x20\x20|^\x20|\x20$"
#: Of texts: what masking changes, but for blanks next to blanks or ends of lines.
_ODD = r"[0-9\x09\x0B-\x0D]"


def _keys(id_col: str, text_col: str) -> dict[str, Column]:
    """Two hashes that tell rows apart, but for rows that are the same; the document, and what tells it apart without an id."""
    k1 = F.xxhash64(F.lit(1), F.col(id_col), F.col(text_col))
    doc = F.col(id_col)
    return {"__k1": k1, "__k2": F.xxhash64(F.col(text_col), F.col(id_col), F.lit(2)), "__doc": doc, "__own": F.when(doc.isNull(), k1)}


#: Of lines grouped by ``_span``: whether they are in several documents.
_SEVERAL = "low < high OR own < last_own OR (low IS NOT NULL AND own IS NOT NULL)"


def _span() -> dict[str, Column]:
    """First and last document of a group of lines; those without id come last, in order of ``__own``."""
    return {"low": F.min("__doc"), "own": F.min("__own"), "high": F.max("__doc"), "last_own": F.max("__own")}


def _masked(line: Column) -> Column:
    """The line's tokens with single blanks between, those with a digit as ``<*>`` in lines that may have fields."""
    fields = F.when(line.rlike(_DIGIT) & line.rlike(_MASKABLE), F.regexp_replace(line, _FIELD, "<*>")).otherwise(line)
    return F.when(line.rlike(_UNEVEN), F.trim(F.regexp_replace(fields, _BLANK, " "))).otherwise(fields)


def _tokens(line: Column) -> Column:
    """Number of tokens of a masked line."""
    return F.when(line == "", 0).otherwise(F.octet_length(line) - F.octet_length(F.replace(line, F.lit(" "), F.lit(""))) + 1)


def _masked_text(text: Column) -> Column:
    """The masked lines of a text. Most texts have none that masking changes, which is looked for in all of them at once."""
    blanks = text.contains("  ") | text.contains(" \n") | text.contains("\n ") | text.startswith(" ") | text.endswith(" ")
    return F.when(text.rlike(_ODD) | blanks, F.transform(F.split(text, "\n"), _masked)).otherwise(F.split(text, "\n"))


def _masked_lines(docs: DataFrame, text_col: str, min_tokens: int, *keep: Column) -> DataFrame:
    """One row per line of ``min_tokens`` tokens or more: keys, place, masked line, tokens."""
    # masked in the array, so that no later step computes it again
    out = docs.select(*keep, F.posexplode(_masked_text(F.col(text_col))).alias("pos", "line"))
    return out.withColumn("n", _tokens(F.col("line"))).where(F.col("n") >= min_tokens)


def _spare(n: Column) -> Column:
    """Tokens of ``n`` that may differ between alike lines."""
    return (n - F.ceil(SIMILARITY * n)).cast("int")


def _run_keys(tokens: Column, n: Column) -> Column:
    """Hashes of which two alike lines of a leaf share one at least."""
    spare, rest, lead = _spare(n), n - LEAD, F.slice(tokens, 1, LEAD)

    def run(k: Column) -> Column:
        begin, end = ((x * rest / (spare + 1)).cast("int") for x in (k, k + 1))
        return F.xxhash64(n, k, lead, F.slice(tokens, begin + LEAD + 1, end - begin))

    def without(k: Column) -> Column:
        return F.xxhash64(n, k, F.slice(tokens, F.lit(1), k - 1), F.slice(tokens, k + 1, n - k))

    return F.when(spare == 1, F.transform(F.sequence(F.lit(LEAD + 1), n), without)).otherwise(F.transform(F.sequence(F.lit(0), spare), run))


def _leaf(n: Column) -> Column:
    """The leaf of a line; in lines too short to be in one only equal lines are alike."""
    return F.when(_spare(n) > 0, F.xxhash64(n, F.call_function("substring_index", F.col("line"), F.lit(" "), F.lit(LEAD))))


def _lines(docs: DataFrame, id_col: str, text_col: str, min_tokens: int) -> DataFrame:
    """One row per line of ``min_tokens`` tokens or more: keys, place, hashes."""
    out = _masked_lines(docs, text_col, min_tokens, *(v.alias(k) for k, v in _keys(id_col, text_col).items()))
    return out.select("__k1", "__k2", "__doc", "__own", "pos", F.xxhash64("line").alias("h"), _leaf(F.col("n")).alias("leaf"))


def _similar(a: Column, b: Column) -> Column:
    def alike(s: Column) -> Column:
        same = F.aggregate(F.zip_with(s["a"], s["b"], lambda x, y: F.when(x == y, 1).otherwise(0)), F.lit(0), lambda n, x: n + x)
        return (F.size(s["a"]) == F.size(s["b"])) & (same >= SIMILARITY * F.size(s["a"]))

    return let(F.struct(F.split(a, " ").alias("a"), F.split(b, " ").alias("b")), alike)


#: Whether the line ``rep`` is in a document before all of the other line's.
_BEFORE = "rep.low < low OR (low IS NULL AND (rep.low IS NOT NULL OR rep.own < own))"


def _alike(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Rows (h): lines of the pairs (h, rep) that are alike."""
    pairs = stored(pairs.distinct(), "line-pairs")
    theirs = texts.select(F.col("h").alias("rep"), F.col("line").alias("rep_line"))
    reps = stored(pairs.groupBy("rep").agg(F.count(F.lit(1)).alias("n")).join(theirs, "rep"), "line-reps")
    both = spread_join(pairs.join(texts, "h"), reps, "rep").where(_similar(F.col("line"), F.col("rep_line")))
    return stored(both.select("h").distinct(), "line-found")


def _with_earlier_like(docs: DataFrame, by_line: DataFrame, text_col: str, min_tokens: int) -> DataFrame:
    """Rows (h, early): lines with a line alike in a document before all of their own."""
    leaves = stored(by_line.where("leaf IS NOT NULL").groupBy("leaf").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "line-leaves")
    need = spread_join(by_line.select("leaf", "h", "low", "own"), leaves, "leaf").select("h", "low", "own")
    texts = _masked_lines(docs, text_col, min_tokens).select(F.xxhash64("line").alias("h"), "line", _leaf(F.col("n")).alias("leaf"))
    if leaves.count() <= BROADCAST_LEAVES:
        # lines of other leaves aren't shuffled
        texts = texts.join(F.broadcast(leaves.select("leaf")), "leaf", "left_semi")
    # a line that very many documents have is one row for each task before it is shuffled
    once = texts.where("leaf IS NOT NULL").groupBy("h").agg(F.first("line").alias("line"))
    lines = stored(once.join(need, "h"), "line-texts")
    keys = let(F.split("line", " "), lambda t: _run_keys(t, F.size(t)))
    rows = stored(lines.select("h", "low", "own", F.posexplode(keys).alias("k", "run"), F.lit(None).cast("array<int>").alias("rest")), "line-runs")
    shared = _shared(rows)
    texts = stored(lines.select("h", "line").join(shared.select("h").distinct(), "h", "left_semi"), "line-candidates")
    pairs_of = lambda both: both.where(_BEFORE).select("h", "rep.h").toDF("h", "rep")
    found = _alike(pairs_of(shared), texts)
    still = stored(shared.where("h != rep.h AND size > 2").drop("rep").join(found, "h", "left_anti"), "line-open")
    # keys of many lines: with few open ones these are compared with all, with many open ones the key is made longer
    wide = stored(still.where(F.col("size") > WIDE).groupBy("run").agg((F.count(F.lit(1)) > WIDE).alias("crowded")), "line-wide")
    narrow, late = shared.where(F.col("size") <= WIDE), still.where(F.col("size") <= WIDE)
    if not wide.isEmpty():
        of_wide = lambda rows, crowded: rows.where(F.col("size") > WIDE).join(F.broadcast(wide.where("crowded" if crowded else "NOT crowded").select("run")), "run", "left_semi")
        all_lines = of_wide(shared, False).select("run", F.struct("low", "own", "h").alias("rep"))
        found = stored(found.unionByName(_alike(pairs_of(of_wide(still, False).select("run", "h", "low", "own").join(all_lines, "run")), texts)), "line-early")
        open_ = of_wide(still, True).join(found, "h", "left_anti")
        if not (open_ := stored(open_, "line-open")).isEmpty():
            wanted = stored(_refined(open_, texts).select("run").distinct(), "line-wanted")
            longer = _shared(stored(_refined(of_wide(shared, True), texts).join(wanted, "run", "left_semi"), "line-runs"))
            found = stored(found.unionByName(_alike(pairs_of(longer), texts)), "line-early")
            narrow = narrow.unionByName(longer)
            late = late.unionByName(longer.where("h != rep.h AND size > 2").drop("rep").join(open_.select("h").distinct(), "h", "left_semi"))
    late = late.join(found, "h", "left_anti")
    return found.unionByName(_by_rank(narrow, late, texts)).distinct().withColumn("early", F.lit(True))


def _shared(rows: DataFrame) -> DataFrame:
    """The rows of keys that several lines have, with the first line and the number of lines of each."""
    place = F.struct(F.col("low").isNull().alias("last"), "low", "own", "h")
    firsts = stored(rows.groupBy("run").agg(F.min(place).alias("rep"), F.count(F.lit(1)).alias("n")).where("n > 1"), "line-firsts")
    return stored(spread_join(rows, firsts.withColumn("size", F.col("n")), "run").select("h", "low", "own", "run", "k", "rest", "rep", "size"), "line-shared")


def _by_rank(shared: DataFrame, still: DataFrame, texts: DataFrame) -> DataFrame:
    """Lines of ``still`` that are alike to another than the first of a key."""
    out, past, upto = texts.select("h").limit(0), 1, REACH
    order = Window.partitionBy("run").orderBy(F.col("low").asc_nulls_last(), "own", "h")
    still = stored(still, "line-open")
    while not still.isEmpty():
        members = shared.where(F.col("size") > past).join(still.select("run").distinct(), "run", "left_semi")
        ranked = members.select("run", "low", "own", "h").withColumn("place", F.row_number().over(order)).where(F.col("place") <= upto)
        reps = ranked.where(F.col("place") > past).select("run", F.struct("low", "own", "h").alias("rep"))
        found = _alike(still.join(reps, "run").where(_BEFORE).select("h", "rep.h").toDF("h", "rep"), texts)
        out = out.unionByName(found)
        still = stored(still.where(F.col("size") > upto).join(found, "h", "left_anti"), "line-open")
        past, upto = upto, upto * REACH
    return out


def _refined(members: DataFrame, texts: DataFrame) -> DataFrame:
    """Longer keys for the lines of keys that too many have.

    The tokens that a key leaves out are cut into one run more than may differ, one of which
    alike lines share. If no more tokens are left than may differ, all lines of the key are alike.
    """
    tokens, n = F.split("line", " "), F.size(F.split("line", " "))
    spare = _spare(n)

    def all_but(k: Column) -> Column:
        begin, end = ((x * (n - LEAD) / (spare + 1)).cast("int") for x in (k, k + 1))
        return F.filter(F.sequence(F.lit(LEAD + 1), n), lambda i: (i <= begin + LEAD) | (i > end + LEAD))

    rest = F.coalesce("rest", F.when(spare == 1, F.array(F.lit(0))).otherwise(all_but(F.col("k"))))
    open_ = members.join(texts, "h").select("h", "low", "own", "run", tokens.alias("tokens"), spare.alias("spare"), rest.alias("rest")).where("size(rest) > spare")
    piece = let(F.struct("tokens", "spare", "rest"), lambda x: F.transform(F.sequence(F.lit(0), x["spare"]), lambda k: _piece(x, k)))
    longer = open_.select("h", "low", "own", "run", F.posexplode(piece).alias("k", "piece"))
    return longer.select("h", "low", "own", F.xxhash64("run", "k", "piece.held").alias("run"), "k", "piece.rest")


def _piece(x: Column, k: Column) -> Column:
    """The tokens of run ``k`` of what a key leaves out, and what the longer key leaves out."""
    begin, end = ((i * F.size(x["rest"]) / (x["spare"] + 1)).cast("int") for i in (k, k + 1))
    held = F.transform(F.slice(x["rest"], begin + 1, end - begin), lambda i: F.get(x["tokens"], i - 1))
    return F.struct(held.alias("held"), F.filter(x["rest"], lambda v, i: (i < begin) | (i >= end)).alias("rest"))


def recurring(docs: DataFrame, lines: DataFrame, text_col: str, min_tokens: int) -> DataFrame:
    """Rows (h, n, keeper, keeper_own) for all lines that go somewhere: their number, and the document that keeps them, if any, by id or else ``__own``."""
    by_line = stored(lines.groupBy("h").agg(*(v.alias(k) for k, v in _span().items()), F.min("leaf").alias("leaf"), F.count(F.lit(1)).alias("n")), "lines-by-hash")
    early = _with_earlier_like(docs, by_line, text_col, min_tokens)
    found = by_line.join(early, "h", "left").where(f"early OR {_SEVERAL}")
    keeps = F.col("early").isNull()
    return stored(found.select("h", "n", F.when(keeps, F.col("low")).alias("keeper"), F.when(keeps & F.col("low").isNull(), F.col("own")).alias("keeper_own")), "recurring")


def dropped_lines(docs: DataFrame, id_col: str, text_col: str, min_tokens: int) -> DataFrame:
    """Rows (__k1, __k2, __gone): the places of the lines that each text loses."""
    lines = stored(_lines(docs, id_col, text_col, min_tokens), "lines")
    found = spread_join(lines.drop("leaf"), recurring(docs, lines, text_col, min_tokens), "h")
    gone = found.where("NOT (coalesce(__doc = keeper, false) OR coalesce(__own = keeper_own, false))")
    return gone.groupBy("__k1", "__k2").agg(F.collect_set("pos").alias("__gone"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_tokens: int = MIN_TOKENS) -> DataFrame:
    """Rows (row, text, dropped): a row of ``docs``, its text without recurring lines, and how many those are."""
    gone = dropped_lines(docs, id_col, text_col, min_tokens)
    keys = [v.alias(k) for k, v in _keys(id_col, text_col).items() if k in ("__k1", "__k2")]
    keyed = docs.select(F.struct(*own(docs)).alias("row"), F.col(id_col).isNull().alias("bare"), F.col(text_col).alias("text"), *keys).join(gone, ["__k1", "__k2"], "left")
    # rows without id that are the same are still documents each: the first of them stands for its text
    turn = F.when(F.col("bare"), F.row_number().over(Window.partitionBy("__k1", "__k2", "bare").orderBy("__k1")))
    every = F.filter(F.transform(F.split("text", "\n"), lambda x, i: F.when(_tokens(_masked(x)) >= min_tokens, i)), lambda i: i.isNotNull())
    keyed = keyed.withColumn("turn", turn).withColumn("__gone", F.when(F.col("turn") > 1, F.when(F.size(every) > 0, every)).otherwise(F.col("__gone")))
    places = lambda x: F.array_except(F.sequence(F.lit(0), F.size(x["lines"]) - 1), x["gone"])
    left = lambda x: F.transform(x["places"], lambda i: F.get(x["lines"], i))
    kept = let(F.struct(F.split("text", "\n").alias("lines"), F.col("__gone").alias("gone")), lambda x: let(F.struct(x["lines"].alias("lines"), places(x).alias("places")), lambda y: F.array_join(left(y), "\n")))
    text = F.when(F.col("__gone").isNull(), F.col("text")).otherwise(kept)
    return keyed.select("row", text.alias("text"), F.coalesce(F.size("__gone"), F.lit(0)).cast("long").alias("dropped"))


def report(docs: DataFrame, **options) -> DataFrame:
    """One row per document: doc_id, text without recurring lines, lines dropped."""
    return dedup_lines(docs.select("doc_id", "text"), **options).select("row.doc_id", "text", F.col("dropped").alias("n_dropped"), F.sha2(F.col("text"), 256).alias("text_sha256"))


def clean_documents(docs: DataFrame, text_col: str = "text", length_col: str = "n_chars", **options) -> DataFrame:
    """``docs`` with recurring lines removed and the length set anew.

    A document that loses lines and has nothing but blanks left goes.
    """
    out = dedup_lines(docs, text_col=text_col, **options)
    given = lambda c: F.col("row").getField(c)
    anew = {text_col: F.col("text")}
    if length_col in docs.columns:
        anew[length_col] = F.when(F.col("dropped") > 0, F.length("text")).otherwise(given(length_col)).cast(docs.schema[length_col].dataType)
    return out.where((F.col("dropped") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]")).select(*(anew.get(c, given(c)).alias(c) for c in docs.columns))
