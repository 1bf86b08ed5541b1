"""Queries of claims, verdicts, leakage, text metrics and streaming over the test tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import naming, tolerance
from ..plans.evaluate import evaluate
from ..plans.storage import shared_folder
from ..sources import files, stores
from ..streaming import reducers
from . import conventions, discover, leakage, textgen, verdict

Query = Callable[[SparkSession, str], DataFrame]


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Values go up by a hair before they are rounded to nine digits: those that end in a five come out alike everywhere.
HAIR = 1 + 1e-12


def _digits(c: str):
    return F.format_string("%.8e", F.col(c) * HAIR).try_cast("double")


def _printed(value: str) -> str:
    return f"CAST(printf('%.8e', ({value}) * {HAIR!r}::DOUBLE) AS DOUBLE)"


def _claim_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers as written, cut off after some digits: out of whole cents, so that no engine has to round."""
    o = _t(spark, sf_dir, "orders").withColumn("cents", F.round(F.col("o_totalprice") * 100).cast("long"))
    k = F.col("o_orderkey") % 5
    cut = lambda by, digits: F.concat(F.floor(F.col("cents") / (by * 10**digits)).cast("string"), F.lit("."), F.lpad((F.floor(F.col("cents") / by) % 10**digits).cast("string"), digits, "0"))
    text = F.when(k == 0, F.concat(cut(10_000, 2), F.lit("%"))).when(k == 1, cut(100, 3)).when(k == 2, F.concat(F.col("o_orderkey").cast("string"), F.lit("x"))).when(k == 3, F.lit("n/a")).otherwise((F.col("o_orderkey") % 2).cast("string"))
    return o.select("o_orderkey", "cents", text.alias("raw"))


def parse_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _claim_numbers(spark, sf_dir).withColumn("c", tolerance.parse_claim(F.col("raw")))
    produced = F.col("cents") / F.when(F.col("o_orderkey") % 5 == 0, 1e8).otherwise(1e5)
    return rows.select("o_orderkey", "c.value", "c.decimals", "c.kind", tolerance.claim_close(F.col("c"), produced).alias("matches"))


PARSE_SQL = """
WITH o AS (SELECT o_orderkey, round(o_totalprice * 100)::BIGINT AS cents FROM orders),
r AS (SELECT *, CASE o_orderkey % 5 WHEN 0 THEN (cents // 1000000) || '.' || lpad((cents // 10000 % 100)::VARCHAR, 2, '0') || '%' WHEN 1 THEN (cents // 100000) || '.' || lpad((cents // 100 % 1000)::VARCHAR, 3, '0')
                          WHEN 2 THEN o_orderkey || 'x' WHEN 3 THEN 'n/a' ELSE CAST(o_orderkey % 2 AS VARCHAR) END AS raw FROM o),
p AS (SELECT *, regexp_extract(replace(raw, ',', ''), '[-+]?\\d*\\.?\\d+(?:[eE][-+]?\\d+)?') AS tok, CASE WHEN raw LIKE '%\\%' ESCAPE '\\' THEN 'percent' WHEN lower(right(raw, 1)) = 'x' THEN 'factor' ELSE 'plain' END AS kind FROM r),
v AS (SELECT *, CASE WHEN tok <> '' THEN CAST(tok AS DOUBLE) / CASE WHEN kind = 'percent' THEN 100 ELSE 1 END END AS value,
             CASE WHEN tok = '' THEN NULL ELSE (CASE WHEN contains(tok, '.') THEN length(tok) - instr(tok, '.') ELSE 0 END + CASE WHEN kind = 'percent' THEN 2 ELSE 0 END) END::INT AS decimals,
             cents / CASE WHEN o_orderkey % 5 = 0 THEN 1e8 ELSE 1e5 END AS produced FROM p)
SELECT o_orderkey, value, decimals, kind,
       coalesce(CASE WHEN decimals = 0 AND abs(value) <= 1 THEN abs(value - produced) <= 1e-9 + 5e-4 * greatest(abs(value), abs(produced)) ELSE abs(value - produced) <= 0.5 * power(10.0::DOUBLE, -decimals) + 1e-9 + 1e-9 * abs(value) END, false) AS matches
FROM v
"""


def canonical_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of metrics as written, for each segment of customers."""
    names = F.array(*[F.lit(x) for x in ("Test Accuracy", "AUROC", "val_f1_score", "Root Mean Squared Error", "nDCG@5 (linear)", "latency", "train MCC", "Sharpe Ratio")])
    rows = _t(spark, sf_dir, "customer").select("c_custkey", F.get(names, (F.col("c_custkey") % 8).cast("int")).alias("name"))
    return rows.select("c_custkey", naming.map_metric(F.col("name")).alias("m")).select("c_custkey", "m.metric", "m.split", "m.confidence")


NAMES_SQL = """
SELECT c_custkey, (['accuracy','roc_auc','f1','rmse','ndcg',NULL,'mcc','sharpe'])[c_custkey % 8 + 1] AS metric, (['test',NULL,'val',NULL,NULL,NULL,'train',NULL])[c_custkey % 8 + 1] AS split,
       ([0.9,0.9,0.9,0.9,0.6,0.0,0.9,0.9])[c_custkey % 8 + 1]::DOUBLE AS confidence FROM customer
"""


def discovered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims found in one report per supplier, with their salience."""
    s = _t(spark, sf_dir, "supplier")
    digits = lambda by, n: F.lpad((F.col("s_suppkey") * by % 10**n).cast("string"), n, "0")
    text = F.concat(F.lit("| Accuracy | 0."), digits(37, 3), F.lit(" |\nF1: 4"), digits(53, 1), F.lit("."), digits(7, 2), F.lit("%\nthe test AUC was 0."), digits(71, 4), F.lit("\n"))
    claims = discover.from_text(s.select(F.col("s_suppkey").cast("string").alias("location"), text.alias("text")))
    return discover.salience(claims).select("location", "metric", "value", "source", "confidence", "split", "salience")


DISCOVERED_SQL = """
SELECT CAST(s_suppkey AS VARCHAR) AS location, c.metric, c.value, c.source, c.confidence, CAST(NULL AS VARCHAR) AS split, c.salience
FROM supplier, unnest([
  {'metric': 'accuracy', 'value': '0.' || lpad((s_suppkey * 37 % 1000)::VARCHAR, 3, '0'), 'source': 'table', 'confidence': 0.9::DOUBLE, 'salience': 0.71::DOUBLE},
  {'metric': 'f1', 'value': '4' || (s_suppkey * 53 % 10) || '.' || lpad((s_suppkey * 7 % 100)::VARCHAR, 2, '0') || '%', 'source': 'text', 'confidence': 0.9::DOUBLE * 0.85::DOUBLE, 'salience': 0.5595::DOUBLE},
  {'metric': 'roc_auc', 'value': '0.' || lpad((s_suppkey * 71 % 10000)::VARCHAR, 4, '0'), 'source': 'prose', 'confidence': 0.9::DOUBLE * 0.7::DOUBLE, 'salience': 0.4365::DOUBLE}]) AS u(c)
"""


def verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A claim per customer nation and part size class about captured calls: bound, recomputed, judged."""
    o = _t(spark, sf_dir, "orders").select((F.col("o_custkey") % 40).alias("c"), F.col("o_orderkey").alias("pos"), (F.col("o_totalprice") > 250_000).cast("int").alias("y"), F.col("o_totalprice"))
    right = F.col("pos") * 7919 % 100 < 40 + F.col("c") % 10 * 5
    inputs = o.select(F.concat(F.lit("call"), "c").alias("call_id"), "c", "pos", "y", F.when(right, F.col("y")).otherwise(1 - F.col("y")).alias("p"))
    recomputed = evaluate(inputs, ["catalog_accuracy"], key="call_id").select(F.col("g").alias("call_id"), F.col("value").alias("recomputed"))
    n = inputs.groupBy("call_id", "c").agg(F.count(F.lit(1)).alias("n"))
    base = recomputed.join(n, "call_id")
    c = F.col("c")
    # two runs: every eighth call differs between them, every fifth reports another number than it computes
    calls = base.select("call_id", "c", "n", "recomputed", F.explode(F.array(F.lit(0), F.lit(1))).alias("run_index")).select(
        "call_id",
        "run_index",
        F.lit(0).cast("long").alias("seq"),
        F.concat(F.lit("acc_"), c).alias("tag"),
        F.lit("accuracy_score").alias("metric"),
        F.concat(F.lit("sink"), c).alias("sink"),
        F.lit("eval").alias("site"),
        F.lit(None).cast("string").alias("label"),
        F.lit(True).alias("user_site"),
        "n",
        (F.col("recomputed") + F.when(c % 5 == 4, 0.2).otherwise(0.0) + F.when((c % 8 == 3) & (F.col("run_index") == 1), 0.01).otherwise(0.0)).alias("result"),
    )
    claims = base.select(
        F.concat(F.lit("claim"), c).alias("id"),
        F.lit("Accuracy").alias("metric"),
        F.format_string("%.3f", F.when(c % 7 == 2, 0.99).otherwise(F.col("recomputed") + F.when(c % 5 == 4, 0.2).otherwise(0.0))).alias("value"),
        F.lit("test").alias("split"),
        F.struct(F.lit(None).cast("int").alias("occurrence"), F.concat(F.lit("sink"), c, F.when(c % 11 == 10, "-none").otherwise("")).alias("sink"), F.lit(None).cast("string").alias("site"), F.lit(None).cast("string").alias("label")).alias("bind"),
    )
    # sinks are matched as substrings, so their names end in a mark
    mark = lambda df, f: df.withColumn(f, F.concat(f, F.lit(";")))
    calls = mark(calls, "sink")
    claims = claims.withColumn("bind", F.col("bind").withField("sink", F.concat("bind.sink", F.lit(";"))))
    bound = verdict.bind(claims, calls)
    first = bound.where("run_index = 0")
    classes = verdict.class_counts(inputs.withColumnRenamed("y", "y_true"))
    rows = (
        claims.select("id", "metric", "value")
        .join(first.select("id", "status", "call_id", F.col("result").alias("produced"), "sink"), "id")
        .join(recomputed, "call_id", "left")
        .join(verdict.determinism(bound), "id", "left")
        .join(classes, "call_id", "left")
        .join(verdict.bad_inputs(inputs, ["p"]), "call_id", "left")
        .withColumn("validity", verdict.validity(naming.canonical(F.col("metric")), F.col("produced"), F.col("classes"), F.col("majority")))
    )
    return verdict.screen(verdict.decide(rows)).select("id", "status", "verdict")


VERDICT_SQL = """
WITH o AS (SELECT o_custkey % 40 AS c, CASE WHEN o_totalprice > 250000 THEN 1 ELSE 0 END AS y, o_orderkey * 7919 % 100 < 40 + o_custkey % 40 % 10 * 5 AS hit FROM orders),
b AS (SELECT c, count(*) AS n, avg(CASE WHEN hit THEN 1.0::DOUBLE ELSE 0 END) AS acc, greatest(avg(y), 1 - avg(y)) AS majority, count(DISTINCT y) AS k FROM o GROUP BY c),
v AS (SELECT *, acc + CASE WHEN c % 5 = 4 THEN 0.2 ELSE 0 END AS produced FROM b),
w AS (SELECT *, CAST(printf('%.3f', CASE WHEN c % 7 = 2 THEN 0.99 ELSE produced END) AS DOUBLE) AS claimed FROM v)
SELECT 'claim' || c AS id, CASE WHEN c % 11 = 10 THEN 'unbound' ELSE 'bound' END AS status,
       CASE WHEN c % 11 = 10 THEN 'INCONCLUSIVE' WHEN abs(claimed - produced) > 0.0005 + 1e-9 + 1e-9 * abs(claimed) THEN 'REFUTED' WHEN abs(produced - acc) > 1e-9 + 1e-6 * greatest(abs(produced), abs(acc)) THEN 'INVALIDATED'
            WHEN k <= 1 OR produced <= majority + 1e-9 THEN 'INVALIDATED' WHEN c % 8 = 3 THEN 'NON-DETERMINISTIC' ELSE 'CONFIRMED' END AS verdict
FROM w
"""


def convention_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which variant of the Sharpe ratio each nation's number is."""
    c = _t(spark, sf_dir, "customer").select("c_nationkey", F.col("c_custkey").alias("pos"), ((F.col("c_acctbal") - 4500) / 2e5).alias("r"))
    cells = conventions.cells(c, "sharpe", "c_nationkey")
    n = F.col("c_nationkey") % 14
    truth = c.groupBy("c_nationkey").agg(F.avg("r").alias("m"), F.stddev_samp("r").alias("s1"), F.stddev_pop("r").alias("s0"))
    periods = F.get(F.array(*map(F.lit, (1.0, 252.0, 260.0, 250.0, 52.0, 12.0, 4.0))), F.floor(n / 2).cast("int"))
    produced = truth.select(F.col("c_nationkey").alias("g"), (F.col("m") / F.when(n % 2 == 0, F.col("s1")).otherwise(F.col("s0")) * F.sqrt(periods)).alias("produced"))
    return conventions.search(produced, cells).select(F.col("g").alias("nation"), "cell")


def bleu(spark: SparkSession, sf_dir: str) -> DataFrame:
    return textgen.bleu(_pairs(spark, sf_dir)).select("g", _digits("value").alias("value"))


def rouge(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _pairs(spark, sf_dir)
    both = textgen.rouge_n(df, 1).withColumn("metric", F.lit("rouge1")).unionByName(textgen.rouge_n(df, 2).withColumn("metric", F.lit("rouge2")))
    return both.select("g", "metric", _digits("value").alias("value"))


def rouge_l(spark: SparkSession, sf_dir: str) -> DataFrame:
    return textgen.rouge_l(_pairs(spark, sf_dir)).select("g", _digits("value").alias("value"))


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn with a reference that has one word more; a null text is empty."""
    c = _t(spark, sf_dir, "conversations").withColumn("text", F.coalesce("text", F.lit("")))
    return c.select((F.col("conv_id") % 5).alias("g"), F.concat_ws(":", "conv_id", "turn").alias("pair"), F.col("text").alias("candidate"), F.concat(F.substring("text", 1, 30), F.lit(" the "), F.expr("substr(text, 31)")).alias("reference"))


_PAIRS_SQL = "SELECT conv_id % 5 AS g, conv_id || ':' || turn AS pair, coalesce(text, '') AS candidate, substr(coalesce(text, ''), 1, 30) || ' the ' || substr(coalesce(text, ''), 31) AS reference FROM conversations"


def _gram_sql(orders: int, low: bool) -> str:
    fold = "lower" if low else ""
    return f"""
WITH p AS ({_PAIRS_SQL}),
s AS (SELECT g, pair, 0 AS side, {fold}(candidate) AS txt FROM p UNION ALL SELECT g, pair, 1, {fold}(reference) FROM p),
w AS (SELECT g, pair, side, list_filter(string_split_regex(txt, '\\s+'), lambda x: x <> '') AS w FROM s),
n AS (SELECT g, pair, side, n.n AS n, array_to_string(w[i.i:i.i + n.n - 1], ' ') AS gram FROM w, unnest(range(1, {orders + 1})) AS n(n), unnest(range(1, len(w) - n.n + 2)) AS i(i)),
c AS (SELECT g, pair, n, gram, count(*) FILTER (side = 0) AS c, count(*) FILTER (side = 1) AS r FROM n GROUP BY ALL),
q AS (SELECT g, pair, n, sum(c)::DOUBLE AS cand, sum(r)::DOUBLE AS ref, sum(least(c, r))::DOUBLE AS shared FROM c GROUP BY ALL)"""


BLEU_SQL = _gram_sql(4, False) + f""",
o AS (SELECT g, n, sum(cand) AS t, sum(ref) AS r, sum(shared) AS m FROM q GROUP BY ALL),
x AS (SELECT g, exp(sum(ln(m / t)) / 4) AS geo, max(t) FILTER (n = 1) AS c, max(r) FILTER (n = 1) AS r FROM o GROUP BY g)
SELECT g, {_printed("geo * CASE WHEN c > r THEN 1 ELSE exp(1 - r / c) END")} AS value FROM x"""
ROUGE_SQL = _gram_sql(2, True) + f""",
a AS (SELECT g, pair, n.n AS n FROM p, unnest([1, 2]) AS n(n))
SELECT g, 'rouge' || n AS metric, {_printed("avg(CASE WHEN shared > 0 THEN 2 * shared / (cand + ref) ELSE 0 END)")} AS value FROM a LEFT JOIN q USING (g, pair, n) GROUP BY g, n"""
# rows of lengths of common subsequences, a word of the candidate at a time
ROUGE_L_SQL = f"""
WITH w AS (SELECT g, list_filter(string_split_regex(lower(candidate), '\\s+'), lambda x: x <> '') AS a, list_filter(string_split_regex(lower(reference), '\\s+'), lambda x: x <> '') AS b FROM ({_PAIRS_SQL})),
l AS (SELECT g, a, b, list_reduce(list_prepend(list_transform(b, lambda y: 0), list_transform(a, lambda x: list_transform(b, lambda y: (x = y)::INT))),
             lambda old, hit: list_transform(range(1, len(b) + 1), lambda j: list_max(list_transform(range(1, j + 1), lambda k: CASE WHEN hit[k] = 1 THEN coalesce(old[k - 1], 0) + 1 ELSE old[k] END)))) AS last FROM w)
SELECT g, {_printed("avg(CASE WHEN len(a) > 0 AND len(b) > 0 THEN 2.0 * last[-1] / (len(a) + len(b)) ELSE 0 END)")} AS value FROM l GROUP BY g"""


def leakage_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _t(spark, sf_dir, "documents")
    return leakage.exact_overlap(d.where("doc_id % 5 != 0").select(F.col("text").alias("row")), d.where("doc_id % 5 = 0").select(F.col("text").alias("row")))


LEAKAGE_SQL = """
WITH a AS (SELECT DISTINCT trim(text, ' ') AS r FROM documents WHERE doc_id % 5 <> 0), b AS (SELECT trim(text, ' ') AS r FROM documents WHERE doc_id % 5 = 0)
SELECT count(*) AS n_test, count(a.r) AS n_overlap, count(a.r) / count(*)::DOUBLE AS overlap_frac FROM b LEFT JOIN a USING (r)
"""


def leakage_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _t(spark, sf_dir, "part")
    return leakage.homology_overlap(p.where("p_partkey % 4 != 0").select(F.col("p_name").alias("row")), p.where("p_partkey % 4 = 0").select(F.col("p_name").alias("row")))


LEAKAGE_NEAR_SQL = """
WITH s AS (SELECT DISTINCT trim(p_name) AS r, p_partkey % 4 = 0 AS test FROM part),
k AS (SELECT r, test, CASE WHEN length(r) < 6 THEN [r] ELSE list_distinct(list_transform(range(1, length(r) - 4), lambda i: substr(r, i, 6))) END AS ks FROM s),
m AS (SELECT DISTINCT b.r FROM k a JOIN k b ON NOT a.test AND b.test AND len(list_intersect(a.ks, b.ks)) >= 0.8 * (len(a.ks) + len(b.ks) - len(list_intersect(a.ks, b.ks)))),
t AS (SELECT trim(p_name) AS r FROM part WHERE p_partkey % 4 = 0)
SELECT count(*) AS n_test, count(m.r) AS n_overlap, count(m.r) / count(*)::DOUBLE AS overlap_frac FROM t LEFT JOIN m USING (r)
"""


def anomalies(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _t(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("key"), F.col("o_totalprice").alias("value"), "o_orderkey")
    return verdict.anomalies(o.select("key", "value", "o_orderkey"), o.select("key", "value")).select("o_orderkey", _digits("z").alias("z"), "is_outlier")


ANOMALY_SQL = f"""
WITH m AS (SELECT o_orderpriority AS key, median(o_totalprice) AS med FROM orders GROUP BY 1),
d AS (SELECT o.o_orderpriority AS key, median(abs(o.o_totalprice - m.med)) AS mad FROM orders o JOIN m ON m.key = o.o_orderpriority GROUP BY 1)
SELECT o_orderkey, {_printed("round_even(0.6744897501960817 * (o_totalprice - med) / mad, 4)")} AS z, abs(0.6744897501960817 * (o_totalprice - med) / mad) > 3.5 AS is_outlier
FROM orders o JOIN m ON m.key = o.o_orderpriority JOIN d ON d.key = o.o_orderpriority
"""


def receipt_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Receipts of orders in one chain per status and priority."""
    o = _t(spark, sf_dir, "orders").select(F.concat_ws("/", "o_orderstatus", "o_orderpriority").alias("series"), F.col("o_orderkey").alias("seq"), F.sha2(F.concat_ws("|", "o_orderkey", "o_custkey", "o_orderstatus"), 256).alias("receipt"))
    return stores.chained(o)


CHAIN_SQL = """
WITH RECURSIVE o AS (SELECT o_orderstatus || '/' || o_orderpriority AS series, o_orderkey AS seq, sha256(concat_ws('|', o_orderkey, o_custkey, o_orderstatus)) AS receipt,
                            row_number() OVER (PARTITION BY o_orderstatus, o_orderpriority ORDER BY o_orderkey) AS rn FROM orders),
r AS (SELECT series, seq, receipt, rn, sha256(receipt) AS entry FROM o WHERE rn = 1
      UNION ALL SELECT o.series, o.seq, o.receipt, o.rn, sha256(r.entry || o.receipt) FROM r JOIN o ON o.series = r.series AND o.rn = r.rn + 1)
SELECT series, seq, receipt, entry FROM r
"""


def text_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers in the JSON properties of events."""
    e = _t(spark, sf_dir, "events").select(F.col("event_id").cast("string").alias("location"), F.col("props").alias("body"))
    return files.flatten_json(e)


LEAVES_SQL = "SELECT CAST(event_id AS VARCHAR) AS location, 'k' AS path, json_extract_string(props, '$.k') AS value FROM events"


def streamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums, means and counts of events by type and hour, through a stream to its end."""
    static = _t(spark, sf_dir, "events")
    # a table is one file here; a stream reads folders
    stream = spark.readStream.schema(static.schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    name = f"folds_{uuid.uuid4().hex}"
    run = reducers.folds(stream, "event_type", "value").writeStream.outputMode("complete").format("memory").queryName(name).trigger(availableNow=True).start()
    run.awaitTermination()
    out = spark.table(name)
    return out.select(F.date_format("window.start", "yyyy-MM-dd HH").alias("hour"), "g", _digits("column_sum").alias("column_sum"), _digits("column_mean").alias("column_mean"), "row_count")


STREAM_SQL = f"""
SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H') AS hour, event_type AS g, {_printed("sum(value)")} AS column_sum, {_printed("avg(value)")} AS column_mean, count(*) AS row_count FROM events GROUP BY ALL
"""


def _event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a stream of returns: series by type, in order of time and id."""
    static = _t(spark, sf_dir, "events")
    stream = spark.readStream.schema(static.schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return stream.select(F.col("event_type").alias("g"), "ts", F.col("event_id").alias("pos"), (((F.col("event_id") * 37) % 201 - 100) / 2000).alias("r"), "value")


def stream_drawdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Worst drawdown of each series at the end of each closed hour, through a stream into files."""
    folder = f"{shared_folder(spark)}/streams/{uuid.uuid4().hex}"
    found = reducers.drawdown_by_window(_event_stream(spark, sf_dir))
    found.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    out = spark.read.schema(found.schema).parquet(f"{folder}/out")
    return out.select("g", F.date_format("window_end", "yyyy-MM-dd HH").alias("hour_end"), _digits("max_drawdown").alias("max_drawdown"), _digits("equity").alias("equity"), "n")


STREAM_DRAWDOWN_SQL = f"""
WITH e AS (SELECT event_type AS g, ts, event_id, date_trunc('hour', ts) + INTERVAL 1 HOUR AS hour_end, 1 + ((event_id * 37) % 201 - 100) / 2000e0 AS f, max(ts) OVER () - INTERVAL 10 MINUTE AS mark FROM events),
q AS (SELECT *, product(f) OVER (PARTITION BY g ORDER BY ts, event_id) AS equity, row_number() OVER (PARTITION BY g ORDER BY ts, event_id) AS n FROM e),
d AS (SELECT *, equity / greatest(1, max(equity) OVER (PARTITION BY g ORDER BY n)) - 1 AS dd FROM q),
w AS (SELECT *, least(0, min(dd) OVER (PARTITION BY g ORDER BY n)) AS worst FROM d)
SELECT g, strftime(hour_end, '%Y-%m-%d %H') AS hour_end, {_printed("min(worst)")} AS max_drawdown, {_printed("max_by(equity, n)")} AS equity, max(n) AS n FROM w WHERE hour_end <= mark GROUP BY g, hour_end
"""


def stream_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantiles of each series over all its rows, computed anew for each batch of a stream."""
    folder = f"{shared_folder(spark)}/streams/{uuid.uuid4().hex}"
    writer = reducers.exact_on_batches(_event_stream(spark, sf_dir).select("g", F.col("value").alias("x")), f"{folder}/rows", ["column_median", "percentile", "column_max"], reducers.results_by_batch(f"{folder}/out"))
    writer.option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return reducers.latest(spark, f"{folder}/out").select("g", "recipe", _digits("value").alias("value"))


STREAM_QUANTILES_SQL = " UNION ALL ".join(
    f"SELECT event_type AS g, '{name}' AS recipe, {_printed(f)} AS value FROM events GROUP BY event_type" for name, f in (("column_median", "median(value)"), ("percentile", "quantile_cont(value, 0.5)"), ("column_max", "max(value)"))
)


def queries() -> dict[str, Query]:
    named = (parse_claims, canonical_names, discovered, verdicts, convention_search, bleu, rouge, rouge_l, leakage_exact, leakage_near, anomalies, receipt_chain, text_leaves, streamed, stream_drawdown, stream_quantiles)
    return {f"engine_{f.__name__}": f for f in named}


def oracle_sql() -> dict[str, str]:
    return {
        "engine_parse_claims": PARSE_SQL,
        "engine_canonical_names": NAMES_SQL,
        "engine_discovered": DISCOVERED_SQL,
        "engine_verdicts": VERDICT_SQL,
        "engine_convention_search": "SELECT DISTINCT c_nationkey AS nation, (c_nationkey % 14)::INT AS cell FROM customer",
        "engine_bleu": BLEU_SQL,
        "engine_rouge": ROUGE_SQL,
        "engine_rouge_l": ROUGE_L_SQL,
        "engine_leakage_exact": LEAKAGE_SQL,
        "engine_leakage_near": LEAKAGE_NEAR_SQL,
        "engine_anomalies": ANOMALY_SQL,
        "engine_receipt_chain": CHAIN_SQL,
        "engine_text_leaves": LEAVES_SQL,
        "engine_streamed": STREAM_SQL,
        "engine_stream_drawdown": STREAM_DRAWDOWN_SQL,
        "engine_stream_quantiles": STREAM_QUANTILES_SQL,
    }
