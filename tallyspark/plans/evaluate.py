"""Plans for recipes: one aggregation per source relation, unpivoted to rows.

The recipes asked for are grouped by their source, so that a hundred one-pass
metrics over one table are a hundred columns of a single partial-and-final
aggregation. Results are rows ``(g, recipe, value, degenerate)``.

A missing or not-a-number cell in a column that a recipe reads makes its value
null for that key (Spark's aggregates would skip it), as does any result that is
null or not finite.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import catalogue
from ..functions.finishers import FINISHERS
from ..functions.recipes import RECIPES, Recipe
from ..functions.row_functions import register, used
from . import quantiles, series
from .solvers import SOLVERS
from .storage import written


@contextmanager
def lenient(spark: SparkSession) -> Iterator[None]:
    """Analyse with x / 0 and the like as null: recipes judge results by their value."""
    key = "spark.sql.ansi.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "false")
    try:
        yield
    finally:
        spark.conf.set(key, before)


#: A value to compute: its name in the result, the recipe, the recipe's parameters.
Cell = tuple[str, str, dict]


def _grouped(cells: Iterable[Cell], blocks: int = 0) -> dict[tuple, list[tuple[str, Recipe, tuple[str, ...]]]]:
    """Cells by source text; those with a finisher stand alone.

    Over the bare relation, exact percentiles and distinct counts are aggregated
    apart: they can't be compiled with the others, which then would not be either.
    """
    out: dict[tuple, list] = {}
    for label, name, params in cells:
        recipe = RECIPES[name]
        where, exprs = recipe.text(blocks, **params)
        text = " ".join(exprs)
        kind = label if recipe.finish or recipe.solver else "" if where != "{t}" else "exact" if re.search(r"\b(percentile|median)\(", text) else "distinct" if "DISTINCT" in text else ""
        out.setdefault((where, kind), []).append((label, recipe, exprs))
    return out


_PERCENTILE = re.compile(r"\bpercentile\((\w+), ([^()]*)\)(?! FILTER)")


def _shared_percentiles(exprs: list[str]) -> list[str]:
    """Have all percentiles of a column come out of one aggregate, which holds its values once."""
    wanted: dict[str, list[str]] = {}
    for e in exprs:
        for column, q in _PERCENTILE.findall(e):
            qs = wanted.setdefault(column, [])
            if q not in qs:
                qs.append(q)
    one = {c: f"percentile({c}, array({', '.join(qs)}))" for c, qs in wanted.items() if len(qs) > 1}
    share = lambda m: f"{one[m[1]]}[{wanted[m[1]].index(m[2])}]" if m[1] in one else m[0]
    return [_PERCENTILE.sub(share, e) for e in exprs]


def _finished(wide: DataFrame, label: str, recipe: Recipe, n: int) -> DataFrame:
    finish = FINISHERS[recipe.finish]

    @F.pandas_udf("double")
    def value(*columns: pd.Series) -> pd.Series:
        def one(*x: object) -> float | None:
            try:
                return None if any(v is None or (isinstance(v, float) and v != v) for v in x) else finish(*x)
            except (ArithmeticError, ValueError):
                return None

        return pd.Series([one(*x) for x in zip(*columns, strict=True)], dtype="float64")

    return wide.select("g", F.lit(label).alias("recipe"), value(*(F.col(f"v{k}") for k in range(n))).alias("value"))


def evaluate(df: DataFrame, ids: Iterable[str], params: dict[str, dict] | None = None, key: str = "g", bind: dict[str, str] | None = None, long: int = series.LONG, block: int = series.BLOCK) -> DataFrame:
    """Values of recipes over ``df``, for each value of ``key``.

    bind: recipe column -> column of ``df`` where the names differ. If a key has more
    than ``long`` rows, ordered recipes run over blocks of ``block`` rows.
    """
    return evaluate_cells(df, [(i, i, (params or {}).get(i, {})) for i in ids], key, bind, long, block)


def evaluate_cells(df: DataFrame, cells: Iterable[Cell], key: str = "g", bind: dict[str, str] | None = None, long: int = series.LONG, block: int = series.BLOCK) -> DataFrame:
    """As ``evaluate``, for recipes under names and with parameters of their own; those of one source share a pass."""
    catalogue.load()
    spark, cells = df.sparkSession, list(cells)
    bind = bind or {}
    ids = [name for _, name, _ in cells]
    needed = sorted({c for i in ids for c in RECIPES[i].columns})
    ordered = any(RECIPES[i].ordered for i in ids)
    if ordered and bind.get("pos", "pos") not in df.columns:
        raise ValueError("an ordered recipe needs the column pos")
    extra = ["pos"] if bind.get("pos", "pos") in df.columns else []
    t = df.select(F.col(key).alias("g"), *(F.col(bind.get(c, c)).alias(c) for c in [*needed, *extra]))
    ordered |= any(RECIPES[i].places for i in ids)
    blocks = block if ordered and series.is_long(t, long) else 0
    # only what recipes read in blocks is put in order and written, or all if that is most of it
    cut = {c for i in ids if blocks and _in_order(RECIPES[i], blocks) for c in RECIPES[i].columns}
    in_order, written_ = None, set()
    if cut:
        written_ = set(needed) if 2 * len(cut) >= len(needed) else cut
        in_order = series.blocked(t.select("g", *sorted(written_), *extra), block)
    results, placed = [], {}
    with lenient(spark):
        for (where, _), found in _grouped(cells, blocks).items():
            flat = [e for _, _, exprs in found for e in exprs]
            flat = flat if blocks else _shared_percentiles(flat)
            label, recipe, _ = found[0]
            if recipe.solver:
                rows = in_order.select("g", *recipe.columns, "pos", "nth") if in_order is not None and set(recipe.columns) <= written_ else t.select("g", *recipe.columns, "pos")
                results.append(SOLVERS[recipe.solver](rows).select("g", F.lit(label).alias("recipe"), "value"))
                continue
            cast = (lambda e: e) if recipe.finish else (lambda e: f"CAST({e} AS DOUBLE)")
            columns = ", ".join(f"{cast(e)} AS v{k}" for k, e in enumerate(flat))
            register(spark, used(columns + where))
            mine = sorted({c for _, r, _ in found for c in r.columns})
            held = in_order if in_order is not None and set(mine) <= written_ else t
            at = (recipe.places, held is t)
            if at not in placed:
                read = sorted({c for i in ids if RECIPES[i].places == recipe.places for c in RECIPES[i].columns}) if recipe.places else [c for c in held.columns if c in needed]
                placed[at] = _placed(held.select("g", *read, *extra, *(["nth", "blk"] if held is not t else [])), recipe.places, blocks)
            rows = placed[at].select("g", *mine, *extra, *(["nth", "blk"] if held is not t else []), *(name for name, _ in recipe.places))
            if blocks and _PERCENTILE.search(columns):
                wide = _with_quantiles(spark, columns, where, rows)
            else:
                wide = spark.sql(f"SELECT g, {columns} FROM {where} src GROUP BY g", t=rows)
            if recipe.finish:
                results.append(_finished(wide, label, recipe, len(flat)))
            else:
                pairs = ", ".join(f"'{x}', v{k}" for k, (x, _, _) in enumerate(found))
                results.append(wide.selectExpr("g", f"stack({len(found)}, {pairs}) AS (recipe, value)"))
        rows = reduce(DataFrame.unionByName, results)
        return _guarded(t, rows, {label: RECIPES[name] for label, name, _ in cells}, needed)


def _in_order(recipe: Recipe, blocks: int) -> bool:
    """Whether a recipe of long keys reads rows in blocks."""
    return bool(recipe.solver == "hurst" or not recipe.solver and re.search(r"\b(nth|blk)\b", recipe.text(blocks)[0]))


def _with_quantiles(spark: SparkSession, columns: str, where: str, rows: DataFrame) -> DataFrame:
    """The aggregates of long groups, with percentiles of columns by selection instead of in one buffer."""
    wanted = sorted({(c, float(spark.sql(f"SELECT CAST({q} AS DOUBLE)").first()[0]), q) for c, q in _PERCENTILE.findall(columns)})
    source = written(spark.sql(f"SELECT * FROM {where} src", t=rows), "long-source")
    held = source.select("g").distinct()
    for column in sorted({c for c, _, _ in wanted}):
        names = {q: f"q{k}__" for k, (c, q, _) in enumerate(wanted) if c == column}
        found = quantiles.exact_quantiles(source, names, "g", column)
        one = found.groupBy("g").agg(*(F.max(F.when(F.col("q") == q, F.col("value"))).alias(n) for q, n in names.items()))
        held = held.join(one, "g", "left")
    number = {(c, text): k for k, (c, _, text) in enumerate(wanted)}
    text = _PERCENTILE.sub(lambda m: f"max(q{number[m[1], m[2]]}__)", columns)
    return spark.sql(f"SELECT z.g, {text} FROM {{source}} z JOIN {{held}} m ON z.g = m.g GROUP BY z.g", source=source, held=held)


def _placed(t: DataFrame, places: tuple[tuple[str, str], ...], blocks: int) -> DataFrame:
    """``t`` with the places of its rows in some orders of their key."""
    for name, order in places:
        by = [F.expr(e) for e in order.split(", ")]
        if blocks:
            keys = [f"order{k}__" for k in range(len(by))]
            t = series.numbered(t.select("*", *(e.alias(k) for k, e in zip(keys, by, strict=True))), ["g"], keys, name).drop(*keys)
        else:
            t = t.withColumn(name, F.row_number().over(Window.partitionBy("g").orderBy(*by)) - 1)
    return t


def _guarded(t: DataFrame, rows: DataFrame, recipes: dict[str, Recipe], needed: list[str]) -> DataFrame:
    """A row for every key and recipe; null values for keys with a bad cell in a column that the recipe reads, or for which it has none."""
    strings = {c for r in recipes.values() for c in r.strings}
    floats = {c for c, kind in t.dtypes if kind in ("double", "float")}
    bad = [F.when(F.count_if(F.col(c).isNull() | (F.isnan(c) if c in floats else F.lit(False))) > 0, F.lit(c)) for c in needed if c not in strings]
    keys = t.groupBy("g").agg(F.array_compact(F.array(*bad)).alias("bad") if bad else F.array().cast("array<string>").alias("bad"))
    reads = F.create_map(*[y for i, r in recipes.items() for y in (F.lit(i), F.array(*[F.lit(c) for c in r.columns]).cast("array<string>"))])
    every = keys.select("g", "bad", F.explode(F.array(*map(F.lit, recipes))).alias("recipe")).alias("k")
    found = rows.alias("r")
    joined = every.join(found, F.col("k.g").eqNullSafe(F.col("r.g")) & (F.col("k.recipe") == F.col("r.recipe")), "left").select("k.g", "k.bad", "k.recipe", "r.value")
    poisoned = F.coalesce(F.arrays_overlap("bad", F.element_at(reads, F.col("recipe"))), F.lit(False))
    value = F.when(~poisoned & _finite("value"), F.col("value"))
    return joined.select("g", "recipe", value.alias("value"), value.isNull().alias("degenerate"))


def _finite(c: str):
    return F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))


def portable(recipe: Recipe) -> bool:
    """Whether the recipe needs neither a finisher nor a row function."""
    return not recipe.finish and not used(recipe.source + " ".join(recipe.exprs))


def ansi_sql(relation: str, ids: Iterable[str], params: dict[str, dict] | None = None) -> str:
    """The same values as one statement of ANSI SQL (g, recipe, value), over a SELECT."""
    catalogue.load()
    parts, tails = [f"base AS ({relation})"], []
    for k, ((where, _), found) in enumerate(_grouped((i, i, (params or {}).get(i, {})) for i in ids).items()):
        columns = ", ".join(f"CAST({e} AS DOUBLE) AS v{j}" for j, e in enumerate(e for _, _, exprs in found for e in exprs))
        mine = sorted({c for _, r, _ in found for c in r.columns} | ({"pos"} if re.search(r"\bpos\b", relation) else set()))
        parts.append(f"t{k} AS (SELECT g, {', '.join(mine) or '1 AS one'} FROM base)")
        where = where.replace("{t}", f"t{k}")
        parts.append(f"s{k} AS MATERIALIZED (SELECT g, {columns} FROM {where} src GROUP BY g)")
        tails += [f"SELECT g, '{x}' AS recipe, v{j} AS value FROM s{k}" for j, (x, _, _) in enumerate(found)]
    text = f"WITH {', '.join(parts)} " + " UNION ALL ".join(tails)
    return re.sub(r"\bpercentile\(", "quantile_cont(", text)
