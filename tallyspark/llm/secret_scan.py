"""Secret scan with corpus-wide ownership frequency, in DataFrame functions only.

Base findings are assignments to secret-sounding names, access key ids and long
hexadecimal runs; they are always reported. Besides them, unnamed key-like tokens
(``TOKEN`` runs with a digit, an upper and a lower case letter) are candidates.
The hash of every value, found or candidate, is counted by distinct repositories
and owners over the whole corpus: a value is a widely copied example if
``EXAMPLE_OWNERS`` owners or more hold it, or several owners in ``EXAMPLE_REPOS``
repositories or more; any other is specific to its owners and looks live.
Live-looking candidates are added as spans of kind "owned".

The repository of a document is its source, the owner the part of that before the
first slash. Positions come from splitting a text at the matches: the lengths of
the parts and of the matches add up to code points, by running sums over a row for
each match. Running extremes over the matches in order tell which candidates
overlap a finding. So the work grows with the number of matches, not its square.

Only hashes are shuffled for the counts, pre-aggregated by (hash, owner,
repository), so a value that a third of the corpus holds is one row per source
and task; values with very many places meet them by broadcast.

Edge cases: a null text is empty, a null source an owner of its own; texts of any
length are scanned whole; repeated rows give equal results; an empty table gives
an empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import spread_join, stored

ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: The lengths say the same as dropping shorter matches: these match whole runs.
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
TOKEN = r"[A-Za-z0-9+/_-]{20,}"
ASSIGN_CHARS = 12
EXAMPLE_OWNERS = 3
EXAMPLE_REPOS = 5
KINDS = ("assign", "access", "hex", "owned")


def _matches(text: Column, pattern: str, kind: int, keep, value_group: int = 0) -> Column:
    """Array of (kind, gap before the match, size, hash of the value, whether it counts), in order."""
    none = F.array().cast("array<struct<kind:int,gap:int,size:int,value:string,counts:boolean>>")
    parts, hits = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(value_group)) if value_group else hits
    rows = F.arrays_zip(F.slice(parts, 1, F.size(hits)).alias("part"), hits.alias("hit"), values.alias("value"))

    def row(r: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), F.length(r["part"]).alias("gap"), F.length(r["hit"]).alias("size"), F.sha2(r["value"], 256).alias("value"), keep(r["value"]).alias("counts"))

    return F.when(text.rlike(pattern), F.transform(rows, row)).otherwise(none)


def matches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", repo_col: str = "source") -> DataFrame:
    """One row per document: its keys, repository, owner, and the matches of all kinds."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    repo = F.coalesce(F.col(repo_col).cast("string"), F.lit(""))
    every = [
        _matches(text, ASSIGN, 0, lambda v: F.length(v) >= ASSIGN_CHARS, 2),
        _matches(text, ACCESS, 1, lambda v: F.lit(True)),
        _matches(text, HEX, 2, lambda v: F.lit(True)),
        _matches(text, TOKEN, 3, lambda v: v.rlike("[0-9]") & v.rlike("[A-Z]") & v.rlike("[a-z]")),
    ]
    return docs.select(
        F.col(id_col).alias("doc_id"),
        F.xxhash64(F.lit(1), F.col(id_col), F.col(text_col), F.col(repo_col)).alias("k1"),
        F.xxhash64(F.col(repo_col), F.col(text_col), F.col(id_col), F.lit(2)).alias("k2"),
        repo.alias("repo"),
        F.substring_index(repo, "/", 1).alias("owner"),
        F.concat(*every).alias("found"),
    )


def spans(found: DataFrame) -> DataFrame:
    """One row per finding and per candidate that overlaps none: keys, repository, owner, kind, start, end, value.

    Rows that are the same count once here; both take what is found.
    """
    once = found.where(F.size("found") > 0).dropDuplicates(["k1", "k2"])
    rows = once.select("k1", "k2", "repo", "owner", F.posexplode("found").alias("at", "m")).select("k1", "k2", "repo", "owner", "at", "m.*")
    upto = Window.partitionBy("k1", "k2", "kind").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    placed = rows.withColumn("end", F.sum(F.col("gap") + F.col("size")).over(upto)).withColumn("start", F.col("end") - F.col("size")).where("counts")
    # findings before candidates of the same start
    onward = Window.partitionBy("k1", "k2").orderBy("start", "kind").rowsBetween(Window.unboundedPreceding, -1)
    back = Window.partitionBy("k1", "k2").orderBy(F.desc("start"), F.desc("kind")).rowsBetween(Window.unboundedPreceding, -1)
    base = F.col("kind") < 3
    clear = (F.coalesce(F.max(F.when(base, F.col("end"))).over(onward), F.lit(0)) <= F.col("start")) & (F.coalesce(F.min(F.when(base, F.col("start"))).over(back), F.col("end")) >= F.col("end"))
    return placed.withColumn("clear", clear).where(base | F.col("clear")).select("k1", "k2", "repo", "owner", "kind", "start", "end", "value")


def ownership(found: DataFrame) -> DataFrame:
    """Rows (value, n_repos, n_owners, n): over the whole corpus, by hash of the value; n counts its rows."""
    by_repo = found.groupBy("value", "owner", "repo").agg(F.count(F.lit(1)).alias("n"))
    by_owner = by_repo.groupBy("value", "owner").agg(F.count(F.lit(1)).alias("repos"), F.sum("n").alias("n"))
    return by_owner.groupBy("value").agg(F.sum("repos").alias("n_repos"), F.count(F.lit(1)).alias("n_owners"), F.sum("n").alias("n"))


def _listed(spans: Column) -> Column:
    name = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(name, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan(docs: DataFrame, example_owners: int = EXAMPLE_OWNERS, example_repos: int = EXAMPLE_REPOS, **columns: str) -> DataFrame:
    """One row per document: counts, digests and spans, and how many look live or copied."""
    found = stored(matches(docs, **columns), "secrets")
    placed = stored(spans(found), "spans")
    copied = (F.col("n_owners") >= example_owners) | ((F.col("n_owners") > 1) & (F.col("n_repos") >= example_repos))
    held = stored(ownership(placed).select("value", "n", copied.alias("copied")), "ownership")
    judged = spread_join(placed.select("k1", "k2", "kind", "start", "end", "value"), held, "value").where(~F.col("copied") | (F.col("kind") < 3))
    count = lambda of: F.count_if(of).alias
    base = F.col("kind") < 3
    by_doc = judged.groupBy("k1", "k2").agg(
        F.array_sort(F.collect_list(F.struct("start", "kind", "end"))).alias("all"),
        *(count(F.col("kind") == k)(f"n_{name}") for k, name in enumerate(KINDS[:3])),
        count(base & ~F.col("copied"))("n_live"),
        count(base & F.col("copied"))("n_example"),
    )
    counts = [*(f"n_{name}" for name in KINDS[:3]), "n_live", "n_example"]
    every = F.coalesce("all", F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>"))
    return (
        found.select("doc_id", "k1", "k2")
        .join(by_doc, ["k1", "k2"], "left")
        .select(
            "doc_id",
            *(F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in counts[:3]),
            F.sha2(_listed(F.filter(every, lambda s: s["kind"] < 3)), 256).alias("base_sha256"),
            _listed(every).alias("spans"),
            *(F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in counts[3:]),
        )
    )


def _sql_spans(kind: int, pattern: str, group: int, keep: str) -> str:
    return f"""
  SELECT k, source, i, kind, start, "end", value FROM (
    SELECT k, source, {kind} AS kind, u.i AS i,
           list_sum(list_transform(parts[1:u.i], lambda x: length(x))) + coalesce(list_sum(list_transform(hits[1:u.i - 1], lambda x: length(x))), 0) AS start,
           list_sum(list_transform(parts[1:u.i], lambda x: length(x))) + list_sum(list_transform(hits[1:u.i], lambda x: length(x))) AS "end", vals[u.i] AS value
    FROM (SELECT k, source, string_split_regex(text, '{pattern}') AS parts, regexp_extract_all(text, '{pattern}', 0) AS hits, regexp_extract_all(text, '{pattern}', {group}) AS vals FROM d) p,
         unnest(range(1, len(hits) + 1)) AS u(i)) WHERE {keep}"""


def _oracle() -> str:
    q = lambda p: p.replace("'", "''")
    key = "regexp_matches(value, '[0-9]') AND regexp_matches(value, '[A-Z]') AND regexp_matches(value, '[a-z]')"
    listed = "coalesce(string_agg(['assign','access','hex','owned'][kind + 1] || ':' || start || ':' || \"end\", ',' ORDER BY start, kind)"
    return f"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
b AS ({_sql_spans(0, q(ASSIGN), 2, f"length(value) >= {ASSIGN_CHARS}")} UNION ALL {_sql_spans(1, ACCESS, 0, "true")} UNION ALL {_sql_spans(2, HEX, 0, "true")}),
t AS ({_sql_spans(3, TOKEN, 0, key)}),
x AS (SELECT * FROM b UNION ALL SELECT * FROM t WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.k = t.k AND b.start < t."end" AND t.start < b."end")),
o AS (SELECT value, count(DISTINCT split_part(source, '/', 1)) >= {EXAMPLE_OWNERS} OR (count(DISTINCT split_part(source, '/', 1)) > 1 AND count(DISTINCT source) >= {EXAMPLE_REPOS}) AS copied FROM x GROUP BY value),
s AS (SELECT x.*, o.copied FROM x JOIN o USING (value) WHERE kind < 3 OR NOT copied)
SELECT doc_id, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
       sha256({listed} FILTER (kind < 3), '')) AS base_sha256, {listed} FILTER (kind IS NOT NULL), '') AS spans,
       count(*) FILTER (kind < 3 AND NOT copied) AS n_live, count(*) FILTER (kind < 3 AND copied) AS n_example
FROM d LEFT JOIN s USING (k) GROUP BY d.k, doc_id
"""


#: The same scan in SQL.
ORACLE_SQL = _oracle()
