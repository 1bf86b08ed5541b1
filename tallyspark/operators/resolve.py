"""From a metric's name and the inputs at hand to a value, with its provenance.

The chain is: trusted catalogue, refusal of learned metrics, recipes, stored
formulas, nothing. Stored formulas are aggregate expressions of SQL over the input
columns; they are parsed and only functions of an allowed list may occur.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import catalogue, naming
from ..functions.tolerance import claim_close, finite, parse_claim
from ..plans.evaluate import evaluate, lenient
from . import verdict

# Inputs that can stand for a tag, other names of recipes, signs of failed runs.
TAG_SOURCES = {
    "label": "y_true target label actual y truth",
    "target": "y_true target actual y truth",
    "prediction": "y_pred prediction pred yhat y",
    "score": "y_score score y_prob prob proba scores",
    "prob": "y_score y_prob prob proba score",
    "value": "values value x data column",
    "return": "returns return values x",
    "benchmark": "benchmark bench market y2",
    "before": "before baseline control x",
    "after": "after candidate treatment y",
    "weight": "sample_weight weight weights",
    "group": "group era fold groups",
    "x": "x values y_true",
    "y": "y y_pred",
}
RECIPE_NAMES = {"cross_entropy": "log_loss", "logloss": "log_loss", "brier_score_loss": "brier", "brier_score": "brier", "sortino_ratio": "sortino", "calmar_ratio": "calmar", "explained_variance_score": "explained_variance", "matthews_corrcoef": "mcc"}
FAILURES = (
    ("CUDA|cuda|nvidia", "needs-gpu"),
    ("out of memory|Killed|MemoryError", "too-heavy"),
    (r"\[timeout\]", "too-slow"),
    ("ModuleNotFoundError|No matching distribution", "missing-dep"),
    ("FileNotFoundError|No such file or directory", "missing-data"),
    ("HTTPError|ConnectionError|URLError", "needs-network"),
)
FORMULA_FUNCTIONS = frozenset(
    "sum avg count min max median percentile stddev_samp stddev_pop var_samp var_pop corr covar_samp covar_pop regr_slope regr_intercept regr_r2 count_if abs sqrt ln log2 exp power pow "
    "greatest least coalesce nullif floor ceil round sign if".split()
)
_WORDS = frozenset("case when then else end and or not null is filter where distinct as double cast between in".split())
SIMILAR = 0.86
WIDTH = 256


def failure(stderr: Column) -> Column:
    """Kind of a failed run."""
    return F.coalesce(*(F.when(stderr.rlike(p), kind) for p, kind in FAILURES), F.lit("errored"))


def error_line(stderr: Column) -> Column:
    """The last exception line, else the last line, of a log's tail."""
    lines = F.filter(F.transform(F.split(stderr, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    errors = F.filter(lines, lambda x: x.rlike(r"^[A-Za-z_][\w.]*(Error|Exception|Warning|Interrupt)\b"))
    return F.substring(F.coalesce(F.try_element_at(errors, F.lit(-1)), F.try_element_at(lines, F.lit(-1)), F.lit("")), 1, 240)


def bind_tags(recipe_id: str, columns: list[str]) -> dict[str, str] | None:
    """Recipe column -> input column, the first available source of each tag; None if one is missing."""
    recipe = catalogue.load()[recipe_id]
    out = {}
    for tag, column in zip(recipe.tags, recipe.columns, strict=True):
        found = next((c for c in TAG_SOURCES.get(tag, tag).split() if c in columns), None)
        if found is None:
            return None
        out[column] = found
    return out


def resolve(metric: str, columns: list[str]) -> tuple[str, str | None, dict[str, str] | None]:
    """(provenance, recipe, binding) of a metric's name for the columns at hand."""
    recipes = catalogue.load()
    name = metric.strip().lower().replace(" ", "_")
    canonical = naming.ALIASES.get(name, name)
    trusted = f"catalog_{canonical}"
    if canonical in naming.CATALOG and trusted in recipes:
        binding = {c: (t if t in columns else c) for t, c in zip(recipes[trusted].tags, recipes[trusted].columns, strict=True)}
        return ("catalog", trusted, binding) if set(binding.values()) <= set(columns) else ("none", None, None)
    if name.replace("-", "_") in naming.LEARNED:
        return "learned", None, None
    own = name if name in recipes else RECIPE_NAMES.get(name)
    if own in recipes:
        binding = bind_tags(own, columns)
        if binding is not None:
            return "recipe", own, binding
    return "none", None, None


def recompute(inputs: DataFrame, metric: str, params: dict | None = None, key: str = "call_id") -> DataFrame | None:
    """Values of a named metric for each call, or None if nothing independent is known."""
    provenance, recipe, binding = resolve(metric, inputs.columns)
    if recipe is None:
        return None
    out = evaluate(inputs, [recipe], {recipe: params} if params else None, key, binding)
    return out.withColumn("provenance", F.lit(provenance))


def check_formula(expression: str, columns: list[str]) -> None:
    """Reject anything but numbers, the given columns, operators and allowed functions."""
    if re.search(r"[;`'\"\\]|--|/\*", expression):
        raise ValueError("quotes, comments and statements aren't allowed in a formula")
    for m in re.finditer(r"[A-Za-z_]\w*", re.sub(r"\d+(\.\d+)?[eE][-+]?\d+", "0", expression)):
        word, called = m[0].lower(), expression[m.end() :].lstrip().startswith("(")
        if word in _WORDS or (word in FORMULA_FUNCTIONS and called) or (not called and m[0] in columns):
            continue
        raise ValueError(f"{m[0]} isn't allowed in a formula")


def formula(inputs: DataFrame, expression: str, key: str = "call_id") -> DataFrame:
    """Rows (g, value) of a checked aggregate expression."""
    check_formula(expression, inputs.columns)
    with lenient(inputs.sparkSession):
        return inputs.groupBy(F.col(key).alias("g")).agg(F.expr(f"CAST({expression} AS DOUBLE)").alias("value"))


def _once(value: Column, f) -> Column:
    """``f(value)`` with the value computed once."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def slot_counts(text: Column) -> Column:
    """Hashed bag of words and three-letter runs: (slot, n) of the slots that aren't empty, fullest first."""
    words = F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))
    runs = lambda ws: F.flatten(F.transform(ws, lambda w: F.when(F.length(w) >= 3, F.transform(F.sequence(F.lit(1), F.greatest(F.length(w) - 2, F.lit(1))), lambda i: F.substr(w, i, F.lit(3)))).otherwise(F.array().cast("array<string>"))))
    # the last two hex digits are the digest modulo 256
    slots = _once(words, lambda ws: F.transform(F.array_distinct(F.concat(ws, runs(ws))), lambda t: F.conv(F.substring(F.md5(t), 31, 2), 16, 10).cast("int")))
    counted = _once(slots, lambda s: F.transform(F.array_distinct(s), lambda k: F.struct((-F.size(F.filter(s, lambda x: x == k))).alias("order"), k.alias("slot"))))
    return F.transform(F.array_sort(counted), lambda x: F.struct(x["slot"].alias("slot"), (-x["order"]).alias("n")))


def square(counts: Column) -> Column:
    """Squared length of a vector of counts."""
    return F.aggregate(counts, F.lit(0).cast("long"), lambda a, x: a + x["n"] * x["n"])


def embed(text: Column) -> Column:
    """The hashed bag of words and three-letter runs as a vector of length one."""

    def dense(counts: Column) -> Column:
        held = F.map_from_entries(counts)
        norm = F.sqrt(square(counts))
        return F.transform(F.sequence(F.lit(0), F.lit(WIDTH - 1)), lambda k: F.coalesce(F.element_at(held, k), F.lit(0)) / F.when(norm == 0, 1.0).otherwise(norm))

    return _once(slot_counts(text), dense)


def cosine(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def lookup(queries: DataFrame, store: DataFrame) -> DataFrame:
    """The stored formula of each query: by name or alias, else the most similar text.

    queries: name; store: metric, aliases, text, expression. A text as similar as
    ``SIMILAR`` has one of the query's heaviest slots: those whose removal leaves a
    vector shorter than that. So they meet by slot, and only such pairs are compared.
    Of equally similar texts the one of the greatest metric is taken.
    """
    q = queries.select(F.lower(F.trim("name")).alias("name")).distinct()
    named = store.select("metric", F.explode(F.array_union(F.array("metric"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("alias"), "expression")
    exact = q.join(named, F.lower("alias") == F.col("name")).groupBy("name").agg(F.min_by(F.struct("metric", "expression"), "metric").alias("x")).select("name", "x.*", F.lit(1.0).alias("score"))
    rest = q.join(exact, "name", "left_anti").select("name", slot_counts(F.col("name")).alias("v"))
    formulas = store.select("metric", "expression", slot_counts(F.concat_ws(" ", "metric", F.concat_ws(" ", "aliases"), "text")).alias("f"))
    slots = rest.select("name", "v", square(F.col("v")).alias("vv"), F.posexplode("v").alias("k", "s"))
    heavier = F.coalesce(F.sum(F.col("s.n") * F.col("s.n")).over(Window.partitionBy("name").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # what is left without the slots before this one is still as long as SIMILAR
    wanted = slots.withColumn("before", heavier).where(F.col("vv") - F.col("before") >= F.col("vv") * (SIMILAR * SIMILAR - 1e-9)).select("name", "v", "vv", "s.slot")
    held = formulas.select("metric", "expression", F.map_from_entries("f").alias("f"), square(F.col("f")).alias("ff"), F.explode("f.slot").alias("slot"))
    pairs = wanted.join(held, "slot").groupBy("name", "metric", "expression").agg(*(F.any_value(c).alias(c) for c in ("v", "vv", "ff")), F.first("f").alias("f"))
    both = F.aggregate("v", F.lit(0).cast("long"), lambda a, x: a + x["n"] * F.coalesce(F.element_at("f", x["slot"]), F.lit(0)))
    scored = pairs.withColumn("score", both / F.sqrt(F.col("vv") * F.col("ff"))).where(F.col("score") >= SIMILAR)
    best = scored.groupBy("name").agg(F.max_by(F.struct("metric", "expression", "score"), F.struct("score", "metric")).alias("x")).select("name", "x.*")
    return exact.unionByName(best)


def validated(cases: DataFrame, formulas: dict[str, tuple[str, str]], trial: str = "trial", tolerance: float = 1e-9) -> DataFrame:
    """Formulas against trusted recipes on many trials at once: rows (metric, trials, agreeing, max_error, trusted).

    formulas: metric -> (checked aggregate expression, recipe). All formulas are columns of one
    aggregation of ``cases`` by trial. A trial whose trusted value is degenerate says nothing;
    one in which the formula has no value, or another one, is enough to refuse it.
    """
    for expression, _ in formulas.values():
        check_formula(expression, cases.columns)
    wanted = sorted({recipe for _, recipe in formulas.values()})
    truth = evaluate(cases, wanted, key=trial).where("NOT degenerate").select(F.col("g").alias("trial"), "recipe", F.col("value").alias("want"))
    with lenient(cases.sparkSession):
        wide = cases.groupBy(F.col(trial).alias("trial")).agg(*(F.expr(f"CAST({e} AS DOUBLE)").alias(f"f{k}") for k, (e, _) in enumerate(formulas.values())))
        made = F.array(*[F.struct(F.lit(m).alias("metric"), F.lit(r).alias("recipe"), F.col(f"f{k}").alias("got")) for k, (m, (_, r)) in enumerate(formulas.items())])
        got = wide.select("trial", F.explode(made).alias("x")).select("trial", "x.*")
        error = F.abs(F.col("got") - F.col("want"))
        agrees = F.coalesce(finite(F.col("got")) & (error <= tolerance), F.lit(False))
        both = got.join(truth, ["trial", "recipe"]).groupBy("metric").agg(F.count(F.lit(1)).alias("trials"), F.count_if(agrees).alias("agreeing"), F.max(error).alias("max_error"))
    return both.withColumn("trusted", F.col("trials") == F.col("agreeing"))


def artifact_verify(claims: DataFrame, values: DataFrame) -> DataFrame:
    """Claims judged by committed predictions alone: claims (id, metric, value) x values (metric, recomputed, classes, majority).

    A worthless score is invalidated here too.
    """
    joined = claims.withColumn("cid", naming.canonical(F.col("metric"))).join(values.withColumnRenamed("metric", "cid"), "cid")
    fits = claim_close(parse_claim(F.col("value")), F.col("recomputed"))
    worthless = verdict.validity(F.col("cid"), F.col("recomputed"), F.col("classes"), F.col("majority"))["invalid"].isNotNull()
    return joined.withColumn("verdict", F.when(~fits, verdict.REFUTED).when(worthless, verdict.INVALIDATED).otherwise(verdict.CONFIRMED))


def merge_artifacts(verdicts: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Verdicts of claims that were only discovered, from committed predictions where there are any."""
    a = artifacts.select("id", F.col("verdict").alias("__a"))
    return verdicts.join(a, "id", "left").withColumn("verdict", F.when(F.col("verdict") == verdict.DISCOVERED, F.coalesce("__a", "verdict")).otherwise(F.col("verdict"))).drop("__a")


def cap_modified(verdicts: DataFrame, modified: Column) -> DataFrame:
    """If a run changed the author's code, an agreeing number isn't the author's any more."""
    affirmative = F.col("verdict").isin(verdict.CONFIRMED, verdict.STOCHASTIC)
    return verdicts.withColumn("verdict", F.when(affirmative & modified, verdict.weaker(F.col("verdict"), F.lit(verdict.REPRODUCED))).otherwise(F.col("verdict")))


def verify_head(claims: DataFrame, n: int) -> DataFrame:
    """``claims`` with ``deep``: whether a claim is among the n most salient; the rest stays discovered."""
    # n rows
    head = claims.orderBy(F.desc("salience"), "metric", "value", "id").limit(n).select("id", F.lit(True).alias("deep"))
    return claims.join(F.broadcast(head), "id", "left").withColumn("deep", F.coalesce("deep", F.lit(False)))


def strided(rows: DataFrame, cap: int, key: str = "dataset", order: str = "pos") -> DataFrame:
    """At most ``cap`` rows of each key at an even stride: a bounded estimate, where one is wanted."""
    w = Window.partitionBy(key)
    numbered = rows.withColumns({"__n": F.count(F.lit(1)).over(w), "__r": F.row_number().over(w.orderBy(order)) - 1})
    step = F.greatest(F.lit(1), F.floor(F.col("__n") / cap))
    return numbered.where((F.col("__n") <= cap) | ((F.col("__r") % step == 0) & (F.col("__r") / step < cap))).drop("__n", "__r")
