"""Guards of a recomputation: enclosures, perturbations, invariances, fabrication, static determinism.

Each works on relations: inputs of many calls at once, or the outputs of a callable
on generated cases, grouped by metric. All of them can only add doubt.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.tolerance import ATOL, RTOL, close, finite
from ..plans.evaluate import evaluate

EPS = 2.0**-52
MATERIAL = 1e-3  # a relative move that counts
LEAST_CASES, LEAST_BASES = 3, 4

# --- enclosures -----------------------------------------------------------------


def enclosures(inputs: DataFrame, key: str = "g", value: str = "x", ddof: int = 1) -> DataFrame:
    """Bounds of the true sum, mean, variance and standard deviation: rows (g, metric, lo, hi).

    Any order of summing n doubles is within n * eps * sum(abs) of the true sum, so
    the bounds hold for Spark's partial sums. Variance is taken about the mean in a
    second pass, its bound carries the mean's error through the squares.
    """
    x = F.col(value).cast("double")
    t = inputs.select(F.col(key).alias("g"), x.alias("x"))
    first = t.groupBy("g").agg(F.count("x").alias("n"), F.sum("x").alias("s"), F.sum(F.abs("x")).alias("a"), F.max(F.abs("x")).alias("top"))
    first = first.withColumn("se", F.col("n") * EPS * F.col("a") + EPS * F.abs("s")).withColumn("m", F.col("s") / F.col("n")).withColumn("me", F.col("se") / F.col("n") + EPS * F.abs("m"))
    d = F.col("x") - F.col("m")
    second = t.join(first.select("g", "m"), "g").groupBy("g").agg(F.sum(d * d).alias("ss"), F.sum(F.abs(d)).alias("ad"))
    both = first.join(second, "g")
    left = F.nullif(F.col("n") - ddof, F.lit(0))
    var = F.col("ss") / left
    move = F.col("me") + EPS * F.col("top")
    ve = (F.col("n") * EPS * F.col("ss") + EPS * F.col("ss") + 2 * F.col("ad") * move) / left + EPS * F.abs(var)
    sd = F.sqrt(var)
    sde = F.when(sd > 0, ve / (2 * sd)).otherwise(F.sqrt(ve))
    rows = [("sum", F.col("s"), F.col("se")), ("mean", F.col("m"), F.col("me")), ("variance", var, ve), ("stdev", sd, sde)]
    made = F.array(*[F.struct(F.lit(n).alias("metric"), (F.greatest(v - e, F.lit(0.0)) if n in ("variance", "stdev") else v - e).alias("lo"), (v + e).alias("hi")) for n, v, e in rows])
    return both.select("g", F.explode(made).alias("r")).select("g", "r.*").where("lo IS NOT NULL AND hi IS NOT NULL")


def band(lo: Column, hi: Column, produced: Column, recomputed: Column) -> Column:
    """inside, outside or straddle: the enclosure against the confirm tolerance around ``produced``."""
    tol = ATOL + RTOL * F.greatest(F.abs(produced), F.abs(recomputed))
    return F.when((lo >= produced - tol) & (hi <= produced + tol), "inside").when((lo > produced + tol) | (hi < produced - tol), "outside").otherwise("straddle")


# --- perturbations --------------------------------------------------------------


def _noise(seed: int, *by: str) -> Column:
    """A number from -1 to 1 that depends on the row and the seed only."""
    return F.pmod(F.xxhash64(F.lit(seed), *by), F.lit(1 << 30)) / float(1 << 29) - 1


def perturbed(inputs: DataFrame, kind: str, key: str = "g", seed: int = 0) -> DataFrame:
    """``inputs`` (key, pos, y, p, s, x) changed in a way that moves a genuine metric."""
    have = set(inputs.columns)
    by_key = Window.partitionBy(key)
    if kind == "drop_tail":
        n, rn = F.count(F.lit(1)).over(by_key), F.row_number().over(by_key.orderBy("pos"))
        return inputs.withColumns({"__n": n, "__r": rn}).where(F.col("__r") <= F.greatest(F.lit(3), F.floor(F.col("__n") * 0.8))).drop("__n", "__r")
    if kind == "flip_pred" and "p" in have:
        low, high = F.min("p").over(by_key), F.max("p").over(by_key)
        return inputs.withColumn("p", F.when(_noise(seed, key, "pos") < -0.2, F.when(F.col("p") == low, high).otherwise(low)).otherwise(F.col("p")))
    if kind == "shuffle_pred" and "p" in have:
        here = Window.partitionBy(key).orderBy("pos")
        there = Window.partitionBy(key).orderBy(_noise(seed, key, "pos"), "pos")
        order = inputs.withColumns({"__a": F.row_number().over(here), "__b": F.row_number().over(there)})
        moved = order.select(F.col(key).alias("__k"), F.col("__b").alias("__t"), F.col("p").alias("__p"))
        return order.join(moved, (F.col(key) == F.col("__k")) & (F.col("__a") == F.col("__t"))).withColumn("p", F.col("__p")).select(*inputs.columns)
    if kind == "negate_score" and "s" in have:
        return inputs.withColumn("s", -F.col("s"))
    column = "s" if kind == "noise_score" else next((c for c in ("r", "x", "p") if c in have), None)
    if kind in ("noise", "noise_score") and column in have:
        spread = F.max(column).over(by_key) - F.min(column).over(by_key)
        return inputs.withColumn(column, F.col(column) + 0.35 * spread * _noise(seed, key, "pos"))
    if kind == "scale" and column in have:
        return inputs.withColumn(column, F.col(column) * 1.7 + 0.3)
    raise ValueError(f"{kind} doesn't apply to columns {sorted(have)}")


def sensitivity(inputs: DataFrame, recipe: str, kinds: list[str], key: str = "g", seed: int = 0) -> DataFrame:
    """Rows (g, kind, base, moved): how far each perturbation moves the trusted value."""
    base = evaluate(inputs, [recipe], key=key).select("g", F.col("value").alias("base"))
    parts = [evaluate(perturbed(inputs, k, key, seed), [recipe], key=key).select("g", F.lit(k).alias("kind"), "value") for k in kinds]
    both = reduce(DataFrame.unionByName, parts).join(base, "g")
    return both.withColumn("moved", F.abs(F.col("value") - F.col("base")) / F.greatest(F.abs("value"), F.abs("base"), F.lit(1e-12))).select("g", "kind", "base", "moved")


def constant_under(oracle: DataFrame, produced: DataFrame) -> DataFrame:
    """Keys whose produced value stays put wherever two perturbations or more move the trusted one.

    oracle, produced: g, kind, moved.
    """
    both = oracle.where(F.col("moved") > MATERIAL).select("g", "kind").join(produced, ["g", "kind"], "left")
    per = both.groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.coalesce("moved", F.lit(0.0)) > MATERIAL).alias("followed"))
    return per.where("n >= 2 AND followed = 0").select("g")


# --- outputs on generated cases --------------------------------------------------

#: Variants of a case that a callable is run on, with the change of its inputs.
TRANSFORMS = ("base", "perm_samples", "perm_labels", "neg_score", "neg_second", "scale_pos", "translate")
# What each variant does to a metric: keep it, times a factor, negate it, or one minus it.
RELATIONS: dict[str, dict[str, str]] = {
    "accuracy": {"perm_samples": "same", "perm_labels": "same"},
    "balanced_accuracy": {"perm_samples": "same", "perm_labels": "same"},
    "f1": {"perm_samples": "same"},
    "precision": {"perm_samples": "same"},
    "recall": {"perm_samples": "same"},
    "mcc": {"perm_samples": "same"},
    "cohen_kappa": {"perm_samples": "same"},
    "roc_auc": {"perm_samples": "same", "neg_score": "complement"},
    "correlation": {"perm_samples": "same", "neg_second": "negated", "scale_pos": "same"},
    "sharpe": {"perm_samples": "same", "scale_pos": "same"},
    "sortino": {"perm_samples": "same", "scale_pos": "same"},
    "mean": {"perm_samples": "same", "scale_pos": "x1.5"},
    "sum": {"perm_samples": "same", "scale_pos": "x1.5"},
    "stdev": {"perm_samples": "same", "scale_pos": "x1.5"},
    "variance": {"perm_samples": "same", "scale_pos": "x2.25"},
    "rmse": {"perm_samples": "same", "translate": "same", "scale_pos": "x1.5"},
    "mae": {"perm_samples": "same", "translate": "same", "scale_pos": "x1.5"},
    "r2": {"perm_samples": "same", "translate": "same", "scale_pos": "same"},
}


def metamorphic(outputs: DataFrame) -> DataFrame:
    """Rows (target, metric, tag, n, violated, broken) for outputs (target, metric, case, tag, value).

    A relation is broken if it fails in most of at least three cases.
    """
    table = outputs.sparkSession.createDataFrame([(m, t, r) for m, rel in RELATIONS.items() for t, r in rel.items()], "metric string, tag string, relation string")
    base = outputs.where((F.col("tag") == "base") & finite(F.col("value"))).select("target", "case", F.col("value").alias("b"))
    pairs = outputs.where(finite(F.col("value"))).join(F.broadcast(table), ["metric", "tag"]).join(base, ["target", "case"])
    rel, b, v = F.col("relation"), F.col("b"), F.col("value")
    want = F.when(rel == "same", b).when(rel == "complement", 1 - b).when(rel == "negated", -b).when(rel == "x1.5", 1.5 * b).when(rel == "x2.25", 2.25 * b)
    per = pairs.groupBy("target", "metric", "tag").agg(F.count(F.lit(1)).alias("n"), F.count_if(~close(want, v)).alias("violated"))
    return per.withColumn("broken", (F.col("n") >= LEAST_CASES) & (F.col("violated") >= F.floor((F.col("n") + 1) / 2)))


def fabricated(outputs: DataFrame) -> DataFrame:
    """Targets that give one value on at least four cases and all their variants."""
    per = outputs.where(finite(F.col("value"))).groupBy("target").agg(F.count_if(F.col("tag") == "base").alias("bases"), F.count_distinct(F.round("value", 12)).alias("distinct"))
    return per.where(f"bases >= {LEAST_BASES} AND distinct = 1").select("target")


def differential(cases: DataFrame) -> DataFrame:
    """Rows (target, clean, diverged, is_diverged) for cases (target, case, produced, default, conventions).

    conventions: values of the standard variants. A case diverges if its output is
    neither the default nor any of them.
    """
    clean = cases.where(finite(F.col("produced")) & finite(F.col("default")))
    off = ~close(F.col("produced"), F.col("default")) & ~F.coalesce(F.exists("conventions", lambda v: close(F.col("produced"), v)), F.lit(False))
    per = clean.groupBy("target").agg(F.count(F.lit(1)).alias("clean"), F.count_if(off).alias("diverged"))
    return per.withColumn("is_diverged", (F.col("clean") >= LEAST_CASES) & (F.col("diverged") >= F.floor((F.col("clean") + 1) / 2)))


# --- static determinism -----------------------------------------------------------

# Names in public libraries that draw random numbers, seed them, or read a clock or the system.
NUMPY_DRAWS = (
    "rand randn randint random ranf random_sample choice shuffle permutation normal uniform standard_normal multivariate_normal multinomial poisson beta gamma binomial bytes geometric "
    "exponential dirichlet laplace logistic"
).split()
STANDARD_DRAWS = "random randint randrange shuffle sample choice choices uniform gauss normalvariate getrandbits betavariate expovariate triangular".split()
GENERATORS = "default_rng RandomState".split()
SPLITTERS = "train_test_split StratifiedKFold KFold ShuffleSplit".split()
ESTIMATORS = "RandomForest ExtraTrees SGD GradientBoosting LGBM XGB CatBoost".split()
SEEDERS = "seed_everything set_seed".split()
GRAPH_SEEDERS = "set_random_seed".split()
CLOCKS = "time time_ns perf_counter perf_counter_ns monotonic monotonic_ns process_time clock".split()
DATES = "now today utcnow".split()
UUIDS = "uuid1 uuid4".split()

_START = r"(?<![\w.])"


def _any(names: list[str], tail: str = "") -> str:
    return rf"(?:{'|'.join(names)}){tail}"


def _calls(names: list[str], of: str = "", tail: str = "", start: str = _START) -> str:
    """Calls of functions, or of functions whose names begin so (tail ``\\w*``), of a module."""
    return rf"{start}{re.escape(of)}{_any(names, tail)}\s*\("


def _module(name: str) -> str:
    """A module imported or used."""
    return rf"{_START}import\s+{name}\b|\bfrom\s+{name}\b|{_START}{name}\."


def _either(*patterns: str) -> str:
    return "|".join(patterns)


_SEEDED_GENERATOR = rf"{_any(GENERATORS)}\s*\(\s*[^)\s]"
#: Library -> (what uses its random numbers, what seeds them).
FAMILIES = {
    "numpy": (_either(rf"np\.random\.{_any(NUMPY_DRAWS)}\b", r"numpy\.random\.", _calls(GENERATORS, start="")), _either(_calls(["seed"], "np.random.", start=""), _calls(["seed"], "numpy.random.", start=""), _SEEDED_GENERATOR, _calls(SEEDERS + GRAPH_SEEDERS, start=""))),
    "random": (_calls(STANDARD_DRAWS, "random."), _either(_calls(["seed"], "random."), _calls(SEEDERS, start=""))),
    "torch": (_module("torch"), _either(_calls(["manual_seed", "manual_seed_all"], start=""), _calls(["seed_everything"], start=""))),
    "tensorflow": (_either(_module("tensorflow"), rf"{_START}tf\.", rf"{_START}keras\b"), _calls(["set_seed", "set_random_seed"], start="")),
    "estimators": (_either(_calls(SPLITTERS, start=r"(?<!\w)"), _calls(ESTIMATORS, tail=r"\w*", start=""), r"\bshuffle\s*=\s*True"), r"(?:random_state|(?<!\w)seed)\s*=\s*(?!None)[\w.]"),
}
UNSEEDED = r"default_rng\s*\(\s*\)"
ENTROPY = _either(_calls(["urandom"], "os.", start=""), rf"{_START}secrets\.\w", _calls(UUIDS, "uuid.", start=""), _calls(["SystemRandom"], start=""), _calls(CLOCKS, "time.", start=""), _calls(DATES, "datetime.", start=""))


def static_determinism(sources: DataFrame, key: str = "repo", text: str = "source") -> DataFrame:
    """Rows (repo, level, seeded, uncontrolled) from source files; only "deterministic" licenses one run."""
    hit = lambda p: F.bool_or(F.col(text).rlike(p))
    flags = [x for name, (use, seed) in FAMILIES.items() for x in (hit(use).alias(f"use_{name}"), hit(seed).alias(f"seed_{name}"))]
    per = sources.groupBy(key).agg(*flags, hit(UNSEEDED).alias("bare"), hit(ENTROPY).alias("entropy"), F.bool_or(F.trim(text) != "").alias("any"))
    pick = lambda seeded: F.array_compact(F.array(*[F.when(F.col(f"use_{n}") & (F.col(f"seed_{n}") == seeded), n) for n in FAMILIES]))
    out = per.withColumns({"seeded": pick(True), "uncontrolled": pick(False)})
    level = F.when(~F.col("any"), "unknown").when((F.size("uncontrolled") > 0) | F.col("bare") | F.col("entropy"), "at_risk").otherwise("deterministic")
    return out.select(key, level.alias("level"), "seeded", "uncontrolled")
