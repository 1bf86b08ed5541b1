"""From claims and captured calls to verdicts, as DataFrame transformations.

``bind`` finds the one call that a claim is about, by metric, hints and sizes and
never by value; ``decide`` is one ordered chain of conditions; overlays can only
weaken a verdict (``weaker``). Claims and calls meet in an equi-join on the
canonical metric, and everything after is windows partitioned by claim.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.naming import canonical, learned
from ..functions.tolerance import claim_close, claim_pad, close, finite, parse_claim

CONFIRMED, STOCHASTIC, REFUTED, INVALIDATED = "CONFIRMED", "CONFIRMED-STOCHASTIC", "REFUTED", "INVALIDATED"
UNSTABLE, REPRODUCED, INCONCLUSIVE, DISCOVERED = "NON-DETERMINISTIC", "REPRODUCED-ONLY", "INCONCLUSIVE", "DISCOVERED"
# Strength of verdicts, split words, Student's t at 99 % by degrees of freedom.
STRENGTH = {CONFIRMED: 100, STOCHASTIC: 90, REFUTED: 55, INVALIDATED: 50, UNSTABLE: 40, REPRODUCED: 30, INCONCLUSIVE: 20, DISCOVERED: 10}
HELD_OUT = ("test", "testing", "val", "valid", "validation", "holdout", "heldout", "dev", "oos", "eval")
TRAIN = ("train", "training")
T99 = (63.657, 9.925, 5.841, 4.604, 4.032, 3.707, 3.499, 3.355, 3.250, 3.169, 3.106, 3.055, 3.012, 2.977, 2.947, 2.921, 2.898, 2.878, 2.861, 2.845, 2.831, 2.819, 2.807, 2.797, 2.787, 2.779, 2.771, 2.763, 2.756, 2.750)
T99_LIMIT = 2.576
ENOUGH_RUNS = 5


def strength(verdict: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in STRENGTH.items() for x in kv]), verdict)


def weaker(now: Column, proposed: Column) -> Column:
    """The weaker verdict; no proposal changes nothing."""
    return F.when(proposed.isNotNull() & (strength(proposed) < strength(now)), proposed).otherwise(now)


def bind(claims: DataFrame, calls: DataFrame) -> DataFrame:
    """One row per claim and run: the call that it is about, and how it was found.

    claims: id, metric, split, bind (struct of occurrence, sink, site, label).
    calls: run_index, call_id, seq, metric, sink, site, label, user_site, n, result.
    """
    key = lambda m: F.coalesce(canonical(m), F.lower(F.trim(m)))
    c = claims.select("id", F.lower("split").alias("split"), "bind", key(F.col("metric")).alias("cid"))
    k = calls.withColumn("cid", key(F.col("metric"))).drop("metric")
    hint = lambda f: F.col(f"bind.{f}")
    fits = (
        (hint("sink").isNull() | F.contains(F.coalesce("sink", F.lit("")), hint("sink")))
        & (hint("site").isNull() | (F.col("site") == hint("site")))
        & (hint("label").isNull() | (F.col("label") == hint("label")))
    )
    runs = calls.select("run_index").distinct()
    found = c.join(k, "cid").where(F.coalesce(fits, F.lit(False)))
    each = Window.partitionBy("id", "run_index")
    found = found.withColumns(
        {"order": F.row_number().over(each.orderBy("seq", "call_id")) - 1, "all": F.count(F.lit(1)).over(each), "user": F.count_if(F.col("user_site")).over(each)}
    )
    occurrence = hint("occurrence")
    # a repository's own calls stand for it where there are any
    own = occurrence.isNotNull() | (F.col("all") == 1) | (F.col("user") == 0) | (F.col("user") == F.col("all")) | F.col("user_site")
    found = found.where(own)
    found = found.withColumns({"left": F.count(F.lit(1)).over(each), "least": F.min("n").over(each), "most": F.max("n").over(each)})
    found = found.withColumn("sizes", F.size(F.collect_set("n").over(each)))
    found = found.withColumn("known", F.count("n").over(each))
    found = found.withColumn("sinks", F.size(F.collect_set(F.coalesce("sink", F.lit("?"))).over(each)))
    distinct_sizes = (F.col("known") == F.col("left")) & (F.col("sizes") == F.col("left"))
    status = (
        F.when(occurrence.isNotNull(), F.when(F.col("order") == occurrence, "bound"))
        .when(F.col("left") == 1, "bound")
        .when(F.col("split").isin(*HELD_OUT) & distinct_sizes, F.when(F.col("n") == F.col("least"), "bound"))
        .when(F.col("split").isin(*TRAIN) & distinct_sizes, F.when(F.col("n") == F.col("most"), "bound"))
        .when((F.col("left") == 2) & (F.col("sinks") == 1) & distinct_sizes, F.when(F.col("n") == F.col("least"), "bound_heuristic"))
        .otherwise("ambiguous")
    )
    picked = found.withColumn("status", status).where("status IS NOT NULL")
    one = picked.groupBy("id", "run_index").agg(
        F.first("status").alias("status"),
        *(F.when(F.first("status") != "ambiguous", F.first(x)).alias(x) for x in ("call_id", "result", "sink", "n")),
        F.max("left").alias("candidates"),
    )
    # every claim gets a row for each run: the runs are one array, gathered from a distinct count of small numbers
    numbers = runs.agg(F.sort_array(F.collect_set("run_index")).alias("runs"))
    every = claims.select("id", F.lit(1).alias("one")).join(numbers.withColumn("one", F.lit(1)), "one").select("id", F.explode("runs").alias("run_index"))
    return every.join(one, ["id", "run_index"], "left").withColumn("status", F.coalesce("status", F.lit("unbound")))


def scope_options(claims: DataFrame, calls: DataFrame) -> DataFrame:
    """For ambiguous claims, the places to choose from, without their values."""
    key = lambda m: F.coalesce(canonical(m), F.lower(F.trim(m)))
    first = calls.where("run_index = 0").select(key(F.col("metric")).alias("cid"), "sink", "site", "n", "label").distinct()
    open_ = bind(claims, calls).where("run_index = 0 AND status = 'ambiguous'").select("id")
    return claims.join(open_, "id", "left_semi").select("id", key(F.col("metric")).alias("cid")).join(first, "cid").groupBy("id").agg(F.sort_array(F.collect_set(F.struct("site", "sink", "n", "label"))).alias("options"))


def determinism(bound: DataFrame) -> DataFrame:
    """Per claim: runs bound for certain, whether all agree with the first, spread, interval."""
    sure = bound.where((F.col("status") == "bound") & finite(F.col("result")))
    first = sure.groupBy("id").agg(F.min_by("result", "run_index").alias("r0"))
    joined = sure.join(first, "id")
    stats = joined.groupBy("id").agg(
        F.count(F.lit(1)).alias("k"),
        F.bool_and(close(F.col("result"), F.col("r0"))).alias("stable"),
        F.min("result").alias("obs_lo"),
        F.max("result").alias("obs_hi"),
        F.avg("result").alias("center"),
        F.stddev_samp("result").alias("sd"),
    )
    t = F.coalesce(F.get(F.array(*map(F.lit, T99)), F.col("k").cast("int") - 2), F.lit(T99_LIMIT))
    half = t * F.col("sd") * F.sqrt(1 + 1 / F.col("k"))
    rng = F.col("obs_hi") - F.col("obs_lo")
    out = stats.withColumns({"spread": rng, "lo": F.least(F.col("center") - half, F.col("obs_lo") - 0.5 * rng), "hi": F.greatest(F.col("center") + half, F.col("obs_hi") + 0.5 * rng)})
    wide = (F.col("hi") - F.col("lo")) > F.greatest(F.abs("center") * 2, F.lit(0.5))
    return out.withColumn("enough", (F.col("k") >= ENOUGH_RUNS) & ~wide)


def validity(metric: Column, produced: Column, classes: Column, majority: Column) -> Column:
    """Struct (invalid, thin): why a reproduced score says nothing, or little."""
    labelled = metric.isin("accuracy", "balanced_accuracy", "f1", "precision", "recall")
    base = F.when(metric == "accuracy", majority).when(metric == "balanced_accuracy", 1 / classes)
    invalid = (
        F.when(labelled & (classes <= 1), "one class only")
        .when(produced <= base + 1e-9, "no better than a constant predictor")
        .when((metric == "roc_auc") & (produced <= 0.5 + 1e-9), "at or below chance")
        .when((metric == "r2") & (produced <= 1e-9), "no better than the mean")
    )
    thin = F.when(invalid.isNull() & (produced <= base + 0.02), "thin margin over a constant predictor").when((metric == "roc_auc") & invalid.isNull() & (produced <= 0.55), "barely above chance")
    return F.struct(invalid.alias("invalid"), thin.alias("thin"))


def class_counts(inputs: DataFrame) -> DataFrame:
    """Per call: number of classes of y_true and the largest class's share."""
    n = inputs.where("y_true IS NOT NULL").groupBy("call_id", "y_true").count()
    return n.groupBy("call_id").agg(F.count(F.lit(1)).alias("classes"), (F.max("count") / F.sum("count")).alias("majority"))


def bad_inputs(inputs: DataFrame, columns: list[str]) -> DataFrame:
    """Calls whose numeric inputs hold a cell that isn't finite."""
    bad = [F.count_if(F.col(c).isNotNull() & ~finite(F.col(c).cast("double"))) > 0 for c in columns]
    return inputs.groupBy("call_id").agg(F.array_contains(F.array(*bad), True).alias("corrupt"))


def decide(rows: DataFrame, proven: Column | None = None, seed_injected: Column | None = None) -> DataFrame:
    """Verdict of each claim.

    rows: id, metric, value (as written), status, produced, recomputed, sink, and
    the columns of ``determinism`` and ``validity`` (as struct ``validity``).
    """
    proven = F.lit(False) if proven is None else proven
    seed = F.lit(False) if seed_injected is None else seed_injected
    # parsed once, behind an exploded array, so that no condition repeats the parsing
    rows = rows.withColumn("__claim", F.explode(F.array(parse_claim(F.col("value")))))
    claim = F.col("__claim")
    produced, recomputed = F.col("produced"), F.col("recomputed")
    known = finite(recomputed)
    tested, stable = F.coalesce(F.col("k") >= 2, F.lit(False)), F.coalesce(F.col("stable"), F.lit(False))
    enough = F.coalesce(F.col("enough"), F.lit(False))
    chance = known & enough & tested & ~stable & ~seed
    pad, width = claim_pad(claim), F.col("hi") - F.col("lo")
    width = F.when(width == 0, F.coalesce(F.nullif(F.abs("center"), F.lit(0.0)), F.lit(1.0))).otherwise(width)
    contains = F.coalesce(claim["value"].between(F.col("obs_lo") - pad, F.col("obs_hi") + pad), F.lit(False))
    outside = F.coalesce((claim["value"] < F.col("lo") - 0.5 * width) | (claim["value"] > F.col("hi") + 0.5 * width), F.lit(False))
    bound = F.col("status").isin("bound", "bound_heuristic")
    invalid = F.col("validity.invalid").isNotNull()
    unstable = tested & ~stable
    verdict = (
        F.when(~bound | ~finite(produced), INCONCLUSIVE)
        .when(~chance & ~claim_close(claim, produced), REFUTED)
        .when(known & ~close(produced, recomputed), INVALIDATED)
        .when(invalid, INVALIDATED)
        .when(known & seed, REPRODUCED)
        .when(known & ~tested, F.when(proven, CONFIRMED).otherwise(REPRODUCED))
        .when(chance, F.when(contains, STOCHASTIC).when(outside, REFUTED).otherwise(INCONCLUSIVE))
        .when(unstable, UNSTABLE)
        .when(known, CONFIRMED)
        .otherwise(REPRODUCED)
    )
    guessed = (F.col("status") == "bound_heuristic") | F.coalesce(F.col("sink").startswith("static:"), F.lit(False))
    capped = F.when(guessed & verdict.isin(CONFIRMED, STOCHASTIC, REPRODUCED), INCONCLUSIVE).otherwise(verdict)
    return rows.withColumns({"claimed": claim["value"], "verdict": capped}).drop("__claim")


def screen(rows: DataFrame) -> DataFrame:
    """Second look at affirmative verdicts: corrupt inputs and worthless scores weaken them."""
    proposed = F.when(F.coalesce(F.col("corrupt"), F.lit(False)), INCONCLUSIVE).when(F.col("validity.invalid").isNotNull(), INVALIDATED)
    affirmative = F.col("verdict").isin(CONFIRMED, STOCHASTIC)
    return rows.withColumn("verdict", F.when(affirmative, weaker(F.col("verdict"), proposed)).otherwise(F.col("verdict")))


def leakage_overlay(rows: DataFrame, leaks: DataFrame) -> DataFrame:
    """Claims about a data set with leaked splits: refuted stays, all else is invalidated."""
    text = F.lower(F.concat_ws(" ", "context", "location"))
    tokens = F.regexp_extract_all(text, F.lit(r"(?:dataset|data|task|name|split_source)\s*=\s*([\w.-]+)"), F.lit(1))
    plain = F.transform(tokens, lambda x: F.regexp_replace(x, "[^a-z0-9]", ""))
    hit = rows.select("id", F.explode(plain).alias("token")).join(leaks.select(F.regexp_replace(F.lower("dataset"), "[^a-z0-9]", "").alias("token")).distinct(), "token").select("id").distinct()
    marked = rows.join(hit.withColumn("leaked", F.lit(True)), "id", "left")
    return marked.withColumn("verdict", F.when(F.col("leaked") & (F.col("verdict") != REFUTED), INVALIDATED).otherwise(F.col("verdict"))).drop("leaked")


def anomalies(values: DataFrame, history: DataFrame, least: int = 15, limit: float = 3.5) -> DataFrame:
    """Robust z of each value against its history by key: advisory only.

    values: key, value; history: key, value.
    """
    med = history.groupBy("key").agg(F.median("value").alias("med"), F.count("value").alias("n"), F.stddev_pop("value").alias("sd"))
    mad = history.join(med, "key").groupBy("key").agg(F.median(F.abs(F.col("value") - F.col("med"))).alias("mad"))
    joined = values.join(med, "key", "left").join(mad, "key", "left")
    # 0.6745 scales a median deviation to a standard deviation
    z = F.when(F.col("n") < least, None).when(F.col("mad") > 0, 0.6744897501960817 * (F.col("value") - F.col("med")) / F.col("mad")).when(F.col("sd") > 0, (F.col("value") - F.col("med")) / F.col("sd"))
    return joined.withColumn("z", F.bround(z, 4)).withColumn("is_outlier", F.coalesce(F.abs(z) > limit, F.lit(False)))


def learned_only(metric: Column) -> Column:
    return learned(metric)


def counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("verdict").agg(F.count(F.lit(1)).alias("n"))
