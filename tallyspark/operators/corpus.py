"""Evaluation corpora: loading, intake rules, distribution, rates, meta-evaluation, generated cases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import verdict as vd

# Vocabularies of the intake rules.
DOMAINS = ("ml", "finance", "statistics", "ir", "nlp", "deeplearning", "genomics", "analytics")
TIERS = ("T1", "T2", "T3", "T4")
SPLITS = ("dev", "test")
SPEC = "name string, domain string, tier string, split string, license string, commit_date string, claims array<struct<id:string,metric:string,value:string,expect:string>>"


def load(spark: SparkSession, path: str) -> DataFrame:
    """Repositories of a YAML corpus with their graded claims; values stay as written."""
    import yaml  # only corpora in YAML need it

    with open(path) as f:
        repos = yaml.safe_load(f)["repos"]
    rows = []
    for r in repos:
        meta = r.get("meta") or {}
        claims = [tuple(None if c.get(k) is None else str(c[k]) for k in ("id", "metric", "value", "expect")) for c in r.get("claims") or []]
        rows.append((r.get("name"), *(None if meta.get(k) is None else str(meta[k]) for k in ("domain", "tier", "split", "license", "commit_date")), claims))
    return spark.createDataFrame(rows, SPEC)


def violations(specs: DataFrame) -> DataFrame:
    """Rows (name, what) of repositories that break an intake rule."""
    say = lambda bad, what: F.when(F.coalesce(bad, F.lit(True)), what)
    found = F.array_compact(
        F.array(
            say(~F.col("domain").isin(*DOMAINS), "domain"),
            say(~F.col("tier").isin(*TIERS), "tier"),
            say(~F.col("split").isin(*SPLITS), "split"),
            say(F.col("license").isNull() | (F.col("license") == ""), "license"),
            say(F.col("commit_date").isNull() | (F.col("commit_date") == ""), "commit_date"),
        )
    )
    rules = specs.select("name", F.explode(found).alias("what"))
    return rules.unionByName(specs.groupBy("name").count().where("count > 1").select("name", F.lit("duplicate name").alias("what")))


def distribution(specs: DataFrame) -> DataFrame:
    """Numbers of repositories by domain and tier, with all subtotals."""
    known = specs.select(*(F.coalesce(F.col(c), F.lit("unknown")).alias(c) for c in ("domain", "tier")))
    return known.cube("domain", "tier").agg(F.count(F.lit(1)).alias("n"))


def graded(specs: DataFrame) -> DataFrame:
    """Claims with an expected verdict."""
    return specs.select("name", "domain", "tier", F.explode("claims").alias("c")).select("name", "domain", "tier", "c.*").where("expect IS NOT NULL")


def rates(results: DataFrame) -> DataFrame:
    """One row of corpus rates from (name, ran, seconds, bound, verdict, expect), a row per claim or a repository without any."""
    repos = results.groupBy("name").agg(F.max("ran").alias("ran"), F.max("seconds").alias("seconds"))
    of_repos = repos.agg(
        F.count(F.lit(1)).alias("repos"),
        F.count_if("ran").alias("ran"),
        F.bround(F.avg(F.col("ran").cast("int")), 3).alias("reproduction_rate"),
        F.bround(F.sum("seconds"), 1).alias("seconds"),
    )
    confirmed = F.col("verdict").isin(vd.CONFIRMED, vd.STOCHASTIC)
    known = F.col("expect").isNotNull()
    of_claims = results.where("verdict IS NOT NULL").agg(
        F.count(F.lit(1)).alias("claims"),
        F.bround(F.avg(F.col("bound").cast("int")), 3).alias("binding_rate"),
        F.count_if(known).alias("graded"),
        F.bround(F.avg(F.when(known, (F.col("verdict") == F.col("expect")).cast("int"))), 3).alias("verdict_accuracy"),
        F.count_if(known & confirmed & ~F.col("expect").isin(vd.CONFIRMED, vd.STOCHASTIC)).alias("false_confirms"),
    )
    # one row each
    return of_repos.crossJoin(of_claims)


def injections(truth: DataFrame, steps: tuple[float, ...] = (1e-4, 1e-3, 1e-2, 5e-2, 0.1)) -> DataFrame:
    """Claims made from true values (id, metric, true): honest, misreported, and swept by relative error."""
    v = F.col("true")
    kinds = [F.struct(F.lit("honest").alias("kind"), F.lit(0.0).alias("rel")), F.struct(F.lit("misreport").alias("kind"), F.lit(0.15).alias("rel"))]
    kinds += [F.struct(F.lit("sweep").alias("kind"), F.lit(s).alias("rel")) for s in steps]
    rows = truth.select("id", "metric", "true", F.explode(F.array(*kinds)).alias("k")).select("id", "metric", "true", "k.*")
    return rows.withColumn("value", F.format_string("%.6f", v * (1 + F.col("rel"))))


def score(judged: DataFrame) -> DataFrame:
    """Rates of a meta-evaluation by kind and size of injection: (kind, rel, n, confirmed, refuted)."""
    share = lambda verdicts: F.avg(F.col("verdict").isin(*verdicts).cast("int"))
    return judged.groupBy("kind", "rel").agg(F.count(F.lit(1)).alias("n"), share((vd.CONFIRMED, vd.STOCHASTIC)).alias("confirmed"), share((vd.REFUTED,)).alias("refuted"))


def seed_effect(runs: DataFrame, tol: float = 1e-9) -> DataFrame:
    """Per target, from (target, seeded, value): whether a seed controls the spread of its runs."""
    spread = lambda s: F.coalesce(F.max(F.when(F.col("seeded") == s, F.col("value"))) - F.min(F.when(F.col("seeded") == s, F.col("value"))), F.lit(0.0))
    per = runs.groupBy("target").agg(spread(False).alias("unseeded"), spread(True).alias("with_seed"))
    return per.withColumn("effect", F.when(F.col("unseeded") <= tol, "deterministic").when(F.col("with_seed") <= tol, "seed-controlled").otherwise("irreducibly random"))


def _uniform(seed: int, *by: str | Column) -> Column:
    return (F.pmod(F.xxhash64(F.lit(seed), *by), F.lit(1 << 40)) + 0.5) / float(1 << 40)


def _normal(seed: int, *by: str) -> Column:
    return F.sqrt(-2 * F.ln(_uniform(seed, *by))) * F.cos(2 * F.pi() * _uniform(seed + 1, *by))


def cases(spark: SparkSession, family: str, n_cases: int, n: int = 40, seed: int = 0) -> DataFrame:
    """Generated inputs of a family of metrics: (case, pos, columns), the same for the same seed."""
    grid = spark.range(n_cases).select(F.col("id").alias("case"), F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("pos"))
    key = ("case", "pos")
    label = F.when(F.col("pos") < 2, F.col("pos")).otherwise((_uniform(seed, *key) < 0.5).cast("int"))
    if family == "labels":
        return grid.withColumn("y", label).withColumn("p", F.when(_uniform(seed + 7, *key) < 0.8, F.col("y")).otherwise(1 - F.col("y")))
    if family == "ranking":
        return grid.withColumn("y", label).withColumn("s", _uniform(seed + 7, *key) * 0.4 + F.col("y") * 0.4)
    if family == "regression":
        return grid.withColumn("y", _normal(seed, *key)).withColumn("p", F.col("y") + 0.3 * _normal(seed + 7, *key))
    if family == "finance":
        return grid.withColumn("r", 0.001 + 0.02 * _normal(seed, *key))
    if family == "values":
        return grid.withColumn("x", _normal(seed, *key))
    if family == "pairs":
        return grid.withColumn("x", _normal(seed, *key)).withColumn("y", 0.7 * F.col("x") + 0.5 * _normal(seed + 7, *key))
    raise ValueError(f"no family {family}")


def variant(inputs: DataFrame, tag: str) -> DataFrame:
    """Generated inputs changed in a way whose effect on a metric is known (see ``robustness.RELATIONS``)."""
    have = set(inputs.columns)
    numbers = [c for c in ("s", "r", "x", "y", "p") if c in have]
    if tag == "base":
        return inputs
    if tag == "perm_samples":
        return inputs.withColumn("pos", F.xxhash64(F.lit(tag), "case", "pos"))
    if tag == "perm_labels":
        return inputs.withColumns({c: 1 - F.col(c) for c in ("y", "p")})
    if tag == "neg_score":
        return inputs.withColumn("s", -F.col("s"))
    if tag == "neg_second":
        return inputs.withColumn("y", -F.col("y"))
    if tag == "scale_pos":
        return inputs.withColumns({c: F.col(c) * 1.5 for c in numbers})
    if tag == "translate":
        return inputs.withColumns({c: F.col(c) + 3.0 for c in numbers})
    raise ValueError(f"no variant {tag}")
