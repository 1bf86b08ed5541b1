"""Queries of guards, resolution and discovery over the test tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import exact
from ..plans.storage import shared_folder
from ..sources import stores
from . import discover, resolve, robustness
from .engine_queries import _digits, _printed, _t

Query = Callable[[SparkSession, str], DataFrame]


def discover_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims of many short reports, merged and numbered: equal ones count once."""
    s = _t(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("location"), (F.col("s_suppkey") % 7).cast("string").alias("a"), (F.col("s_suppkey") % 4).cast("string").alias("b"))
    text = F.concat(F.lit("| Accuracy | 0.8"), F.col("a"), F.lit(" |\nF1: 0.7"), F.col("b"), F.lit("\n"))
    found = discover.discover([discover.from_text(s.select("location", text.alias("text")))])
    return found.select("id", "metric", "value", "location", "source", _digits("confidence").alias("confidence"))


DISCOVER_SQL = f"""
WITH c AS (SELECT 'accuracy' AS metric, '0.8' || s_suppkey % 7 AS value, s_suppkey::VARCHAR AS location, 'table' AS source, 0.9::DOUBLE AS confidence FROM supplier
           UNION ALL SELECT 'f1', '0.7' || s_suppkey % 4, s_suppkey::VARCHAR, 'text', 0.9::DOUBLE * 0.85::DOUBLE FROM supplier),
b AS (SELECT metric, value, min(location) AS location, source, confidence FROM c GROUP BY ALL)
SELECT 'd' || (row_number() OVER (ORDER BY confidence DESC, metric, value) - 1) || '_' || metric AS id, metric, value, location, source, {_printed("confidence")} AS confidence FROM b
"""


def resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics by name, from the inputs at hand, with where the number comes from."""
    c = _t(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("call_id"), F.col("c_custkey").alias("pos"), (F.col("c_acctbal") > 3000).cast("int").alias("y_true"), (F.col("c_custkey") * 7919 % 100 < F.when(F.col("c_acctbal") > 3000, 70).otherwise(30)).cast("int").alias("y_pred"))
    out = None
    for name in ("Accuracy", "MSE", "specificity", "BERTScore", "no such metric"):
        found = resolve.recompute(c, name)
        if found is not None:
            one = found.select(F.col("g").alias("nation"), F.lit(name).alias("metric"), _digits("value").alias("value"), "provenance")
            out = one if out is None else out.unionByName(one)
    return out


RESOLVED_SQL = f"""
WITH c AS (SELECT c_nationkey AS nation, c_acctbal > 3000 AS y, c_custkey * 7919 % 100 < CASE WHEN c_acctbal > 3000 THEN 70 ELSE 30 END AS p FROM customer),
v AS (SELECT nation, avg((y = p)::INT) AS acc, avg((y <> p)::INT) AS mse, count(*) FILTER (NOT y AND NOT p) / nullif(count(*) FILTER (NOT y), 0) AS spec FROM c GROUP BY nation)
SELECT nation, 'Accuracy' AS metric, {_printed("acc")} AS value, 'catalog' AS provenance FROM v UNION ALL SELECT nation, 'MSE', {_printed("mse")}, 'catalog' FROM v
UNION ALL SELECT nation, 'specificity', {_printed("spec")}, 'recipe' FROM v
"""


def enclosed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Middles of the enclosures of sums, means and spreads, and whether they are as narrow as doubles allow."""
    o = _t(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("g"), F.col("o_totalprice").alias("x"))
    found = robustness.enclosures(o).withColumn("middle", (F.col("lo") + F.col("hi")) / 2)
    return found.select("g", "metric", _digits("middle").alias("middle"), (F.col("hi") - F.col("lo") < F.abs("middle") * 1e-6).alias("narrow"))


ENCLOSED_SQL = " UNION ALL ".join(
    f"SELECT o_orderpriority AS g, '{name}' AS metric, {_printed(f'{f}(o_totalprice)')} AS middle, true AS narrow FROM orders GROUP BY o_orderpriority"
    for name, f in (("sum", "fsum"), ("mean", "favg"), ("variance", "var_samp"), ("stdev", "stddev_samp"))
)


#: Prices with signs and powers of two that cancel, so that the order of a plain sum shows.
HEAVY = "CASE o_orderkey % 3 WHEN 0 THEN 1099511627776e0 WHEN 1 THEN -1099511627776e0 ELSE 1e0 END * o_totalprice"


def exact_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Doubles nearest to the true sums, and whether the rough enclosures hold the true sum, mean, variance and deviation."""
    t = _t(spark, sf_dir, "orders").select((F.col("o_custkey") % 50).alias("g"), F.expr(HEAVY).alias("x"))
    rough = robustness.enclosures(t).select("g", "metric", F.col("lo").alias("low"), F.col("hi").alias("high"))
    both = exact.exact_moments(t).join(rough, ["g", "metric"], "left").groupBy("g", "n")
    holds = F.coalesce((F.col("low") <= F.col("lo")) & (F.col("hi") <= F.col("high")), F.lit(False))
    return both.agg(F.max(F.when(F.col("metric") == "sum", F.col("value"))).alias("total"), F.min(holds).alias("contained"), F.count(F.lit(1)).alias("metrics"))


#: Whole numbers of 2^-46, added exactly; then the 53 leading bits, rounded to the nearest, ties to even.
EXACT_SQL = f"""
WITH o AS (SELECT o_custkey % 50 AS g, CAST(({HEAVY}) * pow(2, 46) AS HUGEINT) AS m FROM orders),
s AS (SELECT g, count(*) AS n, sum(m)::HUGEINT AS s FROM o GROUP BY g),
a AS (SELECT *, CASE WHEN s < 0 THEN -s ELSE s END AS m FROM s),
b AS (SELECT *, greatest(floor(log2(greatest(m, 1)::DOUBLE))::INT - 52, 0) AS k FROM a),
c AS (SELECT *, CASE WHEN k > 0 AND m // pow(2, k)::HUGEINT < pow(2, 52)::HUGEINT THEN k - 1 ELSE k END AS cut FROM b),
d AS (SELECT *, pow(2, cut)::HUGEINT AS unit, m // pow(2, cut)::HUGEINT AS q, m % pow(2, cut)::HUGEINT AS left_ FROM c),
e AS (SELECT *, CASE WHEN 2 * left_ > unit OR (2 * left_ = unit AND q % 2 = 1) THEN q + 1 ELSE q END AS near FROM d)
SELECT g, n, CASE WHEN s < 0 THEN -1 ELSE 1 END * near::DOUBLE * pow(2, cut - 46) AS total, true AS contained, CASE WHEN n > 1 THEN 4 ELSE 2 END AS metrics FROM e
"""


def perturbed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far the mean of a column moves if a fifth of its rows goes, or all are scaled."""
    o = _t(spark, sf_dir, "orders").select((F.col("o_custkey") % 20).alias("g"), F.col("o_orderkey").alias("pos"), F.col("o_totalprice").alias("x"))
    return robustness.sensitivity(o, "column_mean", ["drop_tail", "scale"]).select("g", "kind", _digits("base").alias("base"), _digits("moved").alias("moved"))


PERTURBED_SQL = f"""
WITH o AS (SELECT o_custkey % 20 AS g, o_totalprice AS x, row_number() OVER (PARTITION BY o_custkey % 20 ORDER BY o_orderkey) AS rn, count(*) OVER (PARTITION BY o_custkey % 20) AS n FROM orders),
v AS (SELECT g, avg(x) AS base, avg(x) FILTER (rn <= greatest(3, floor(n * 0.8))) AS cut, avg(x * 1.7 + 0.3) AS scaled FROM o GROUP BY g)
SELECT g, 'drop_tail' AS kind, {_printed("base")} AS base, {_printed("abs(cut - base) / greatest(abs(cut), abs(base))")} AS moved FROM v
UNION ALL SELECT g, 'scale', {_printed("base")}, {_printed("abs(scaled - base) / greatest(abs(scaled), abs(base))")} FROM v
"""


def metamorphic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relations between a callable's outputs on a case and on its variants; some callables break them."""
    n = _t(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("target"), F.explode(F.sequence(F.lit(0), F.lit(4))).alias("case"))
    n = n.withColumn("b", (F.col("target") * 7 + F.col("case")) / 200).withColumn("metric", F.when(F.col("target") % 2 == 0, "rmse").otherwise("roc_auc"))
    odd = F.col("target") % 2 == 1
    variants = F.array(
        F.struct(F.lit("base").alias("tag"), F.col("b").alias("value")),
        F.struct(F.lit("perm_samples").alias("tag"), (F.col("b") + F.when(F.col("target") % 5 == 0, 0.1).otherwise(0.0)).alias("value")),
        F.struct(F.when(odd, "neg_score").otherwise("scale_pos").alias("tag"), F.when(F.col("target") % 3 == 0, F.col("b") + 0.01 * F.col("case")).when(odd, 1 - F.col("b")).otherwise(1.5 * F.col("b")).alias("value")),
    )
    outputs = n.select("target", "metric", "case", F.explode(variants).alias("v")).select("target", "metric", "case", "v.*")
    return robustness.metamorphic(outputs)


METAMORPHIC_SQL = """
WITH n AS (SELECT n_nationkey AS target, c.c AS "case", (n_nationkey * 7 + c.c) / 200 AS b, CASE WHEN n_nationkey % 2 = 0 THEN 'rmse' ELSE 'roc_auc' END AS metric FROM nation, range(5) AS c(c)),
v AS (SELECT target, metric, 'perm_samples' AS tag, target % 5 = 0 AS wrong FROM n
      UNION ALL SELECT target, metric, CASE WHEN target % 2 = 1 THEN 'neg_score' ELSE 'scale_pos' END, target % 3 = 0 AND abs(b + 0.01 * "case" - CASE WHEN target % 2 = 1 THEN 1 - b ELSE 1.5 * b END) > 1e-9 + 1e-6 * greatest(abs(b + 0.01 * "case"), abs(CASE WHEN target % 2 = 1 THEN 1 - b ELSE 1.5 * b END)) FROM n)
SELECT target, metric, tag, count(*) AS n, count(*) FILTER (wrong) AS violated, count(*) FILTER (wrong) >= 3 AS broken FROM v GROUP BY ALL
"""

_SNIPPETS = ("x = 1", "np.random.seed(0)\\nnp.random.rand(3)", "np.random.rand(3)", "random.shuffle(x)", "import torch", "start = time.time()", "rng = default_rng()", "train_test_split(x, random_state=1)")


def static_determinism(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether sources seed what they draw, by library."""
    texts = F.array(*[F.lit(x.replace("\\n", "\n")) for x in _SNIPPETS])
    p = _t(spark, sf_dir, "part").select(F.col("p_partkey").alias("repo"), F.get(texts, (F.col("p_partkey") % len(_SNIPPETS)).cast("int")).alias("source"))
    found = robustness.static_determinism(p)
    return found.select("repo", "level", F.array_join("seeded", ",").alias("seeded"), F.array_join("uncontrolled", ",").alias("uncontrolled"))


STATIC_SQL = """
SELECT p_partkey AS repo, ['deterministic', 'deterministic', 'at_risk', 'at_risk', 'at_risk', 'at_risk', 'at_risk', 'deterministic'][p_partkey % 8 + 1] AS level,
       ['', 'numpy', '', '', '', '', '', 'estimators'][p_partkey % 8 + 1] AS seeded, ['', '', 'numpy', 'random', 'torch', '', 'numpy', ''][p_partkey % 8 + 1] AS uncontrolled FROM part
"""


def formula_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored formulas by name or alias, in any case; unlike names find none."""
    store = spark.createDataFrame([("profit_share", ["margin share"], "profit over revenue", "sum(p) / sum(r)"), ("unit_cost", [], "cost for each unit", "sum(c) / sum(n)")], "metric string, aliases array<string>, text string, expression string")
    names = F.array(*[F.lit(x) for x in ("Profit_Share", " margin share", "UNIT_COST", "latency of the ninth percentile")])
    s = _t(spark, sf_dir, "supplier").select(F.get(names, (F.col("s_suppkey") % 4).cast("int")).alias("name"))
    return resolve.lookup(s, store)


LOOKUP_SQL = """
SELECT DISTINCT ['profit_share', 'margin share', 'unit_cost'][s_suppkey % 4 + 1] AS name, ['profit_share', 'profit_share', 'unit_cost'][s_suppkey % 4 + 1] AS metric,
       ['sum(p) / sum(r)', 'sum(p) / sum(r)', 'sum(c) / sum(n)'][s_suppkey % 4 + 1] AS expression, 1.0::DOUBLE AS score FROM supplier WHERE s_suppkey % 4 < 3
"""


def formula_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Formulas for names of parts, in two versions of a store; each part asks by name, alias, or something like them."""
    p = _t(spark, sf_dir, "part")
    name, number = F.lower(F.concat_ws(" ", "p_name", "p_brand")), F.regexp_extract("p_brand", "[0-9]+", 0).cast("int")
    records = p.select(name.alias("metric"), F.array(F.concat_ws(" ", "p_brand", "p_name")).alias("aliases"), F.lit("").alias("text"), number.alias("number")).distinct()
    path = f"{shared_folder(spark)}/formulas-{uuid.uuid4().hex}"
    stores.add_formulas(records.withColumn("expression", F.lit("sum(x)")), path)
    stores.add_formulas(records.where("number % 3 = 0").withColumn("expression", F.concat(F.lit("sum(x) / "), F.col("number"))), path)
    asked = F.element_at(F.array(F.upper(F.concat_ws(" ", "p_name", "p_brand")), F.concat_ws(" ", "p_brand", "p_name"), F.concat(F.lit("the "), name, F.lit("s")), F.col("p_name")), (F.col("p_partkey") % 4 + 1).cast("int"))
    found = resolve.lookup(p.select(asked.alias("name")), stores.formulas(spark, path))
    return found.select("name", "metric", "expression", _digits("score").alias("score"))


#: All names against all formulas by their slots.
STORE_SQL = f"""
WITH p AS (SELECT *, lower(p_name || ' ' || p_brand) AS metric, regexp_extract(p_brand, '[0-9]+')::INT AS number FROM part),
f AS (SELECT DISTINCT metric, lower(p_brand || ' ' || p_name) AS alias, metric || ' ' || p_brand || ' ' || p_name || ' ' AS body, CASE WHEN number % 3 = 0 THEN 'sum(x) / ' || number ELSE 'sum(x)' END AS expression FROM p),
q AS (SELECT DISTINCT lower(trim([p_name || ' ' || p_brand, p_brand || ' ' || p_name, 'the ' || metric || 's', p_name][p_partkey % 4 + 1])) AS name FROM p),
e AS (SELECT q.name, min(f.metric) AS metric, min_by(f.expression, f.metric) AS expression FROM q JOIN f ON q.name = f.metric OR q.name = f.alias GROUP BY q.name),
t AS (SELECT 'q' AS kind, name AS id, regexp_extract_all(name, '[a-z0-9]+') AS w FROM q WHERE name NOT IN (SELECT name FROM e) UNION ALL SELECT 'f', metric, regexp_extract_all(lower(body), '[a-z0-9]+') FROM f),
g AS (SELECT kind, id, unnest(list_distinct(list_concat(w, flatten(list_transform(w, lambda x: list_transform(range(1, greatest(length(x) - 1, 1)::BIGINT), lambda i: substr(x, i, 3))))))) AS token FROM t),
s AS (SELECT kind, id, ('0x' || substr(md5(token), 31, 2))::INT AS slot, count(*) AS n FROM g GROUP BY ALL),
l AS (SELECT kind, id, sum(n * n) AS n2 FROM s GROUP BY ALL),
d AS (SELECT a.id AS name, b.id AS metric, sum(a.n * b.n) AS dot FROM s a JOIN s b ON a.slot = b.slot AND a.kind = 'q' AND b.kind = 'f' GROUP BY ALL),
c AS (SELECT d.name, d.metric, dot / sqrt(u.n2 * v.n2) AS score FROM d JOIN l u ON u.kind = 'q' AND u.id = d.name JOIN l v ON v.kind = 'f' AND v.id = d.metric),
r AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY score DESC, metric DESC) AS turn FROM c WHERE score >= 0.86)
SELECT name, metric, expression, {_printed("1.0")} AS score FROM e UNION ALL SELECT r.name, r.metric, f.expression, {_printed("r.score")} FROM r JOIN f ON f.metric = r.metric WHERE turn = 1
"""

FORMULAS = {
    "accuracy": ("avg(CASE WHEN y = p THEN 1 ELSE 0 END)", "catalog_accuracy"),
    "mean absolute error": ("sum(greatest(p - y, y - p)) / count(p)", "catalog_mae"),
    "error without its sign": ("avg(p - y)", "catalog_mae"),
    "root mean square": ("power(avg(p * p - 2 * p * y + y * y), 0.5)", "catalog_rmse"),
    "deviation of a population": ("stddev_pop(x)", "catalog_stdev"),
    "deviation of a sample": ("sqrt((sum(x * x) - sum(x) * sum(x) / count(x)) / (count(x) - 1))", "catalog_stdev"),
}


def formula_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forty trials of formulas from outside against trusted metrics; wrong ones are refused."""
    o = _t(spark, sf_dir, "orders").select((F.col("o_custkey") % 40).alias("trial"), (F.col("o_orderkey") * 31 % 4).alias("y"), (F.col("o_orderkey") * 17 % 5).alias("p"), (F.col("o_totalprice") / 1e5).alias("x"))
    return resolve.validated(o, FORMULAS).withColumn("max_error", F.round("max_error", 6))


VALIDATION_SQL = """
WITH o AS (SELECT o_custkey % 40 AS trial, o_orderkey * 31 % 4 AS y, o_orderkey * 17 % 5 AS p, o_totalprice / 1e5 AS x FROM orders),
v AS (SELECT trial, avg(abs(p - y)) AS mae, avg(p - y) AS bias, stddev_samp(x) AS sd, stddev_pop(x) AS sd0, count(*) AS n FROM o GROUP BY trial)
SELECT 'accuracy' AS metric, count(*) AS trials, count(*) AS agreeing, 0e0 AS max_error, true AS trusted FROM v
UNION ALL SELECT 'mean absolute error', count(*), count(*), 0e0, true FROM v
UNION ALL SELECT 'root mean square', count(*), count(*), 0e0, true FROM v
UNION ALL SELECT 'deviation of a sample', count(*), count(*), 0e0, true FROM v WHERE n > 1
UNION ALL SELECT 'error without its sign', count(*), count(*) FILTER (abs(bias - mae) <= 1e-9), round(max(abs(bias - mae)), 6), count(*) FILTER (abs(bias - mae) <= 1e-9) = count(*) FROM v
UNION ALL SELECT 'deviation of a population', count(*), count(*) FILTER (abs(sd - sd0) <= 1e-9), round(max(abs(sd - sd0)), 6), count(*) FILTER (abs(sd - sd0) <= 1e-9) = count(*) FROM v WHERE n > 1
"""


def queries() -> dict[str, Query]:
    named = (discover_all, resolved, enclosed, exact_sums, perturbed, metamorphic, static_determinism, formula_lookup, formula_store, formula_validation)
    return {f"engine_{f.__name__}": f for f in named}


def oracle_sql() -> dict[str, str]:
    return {
        "engine_discover_all": DISCOVER_SQL,
        "engine_resolved": RESOLVED_SQL,
        "engine_enclosed": ENCLOSED_SQL,
        "engine_exact_sums": EXACT_SQL,
        "engine_perturbed": PERTURBED_SQL,
        "engine_metamorphic": METAMORPHIC_SQL,
        "engine_static_determinism": STATIC_SQL,
        "engine_formula_lookup": LOOKUP_SQL,
        "engine_formula_store": STORE_SQL,
        "engine_formula_validation": VALIDATION_SQL,
    }
