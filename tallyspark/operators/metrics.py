"""Queries of the metric recipes over the test tables.

Each shape is a relation of named columns built from a table in plain SQL, and the
recipes that are bound to it.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import catalogue
from ..plans.evaluate import evaluate, lenient, portable
from .expected import EXPECTED, statement
from .shapes import SHAPES, edged

Query = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Shape:
    name: str
    table: str
    relation: str
    recipes: tuple[str, ...]
    params: dict


def _shapes() -> list[Shape]:
    """Each recipe belongs to the first shape of its family that has its columns."""
    catalogue.load()
    taken: set[str] = set()
    out = []
    for name, (table, _, families, columns, params) in SHAPES.items():
        have = set(columns.split())
        mine = tuple(r.id for r in catalogue.RECIPES.values() if r.family in families and r.id not in taken and set(r.columns) <= have)
        taken |= set(mine)
        out.append(Shape(name, table, edged(name), mine, {k: v for k, v in params.items() if k in mine}))
    return out


def unbound() -> list[str]:
    """Recipes that no shape covers."""
    bound = {r for s in _shapes() for r in s.recipes}
    return [r for r in catalogue.RECIPES if r not in bound]


#: Second differences of sums that agree in most digits.
LOOSE = ("effective_convexity",)
HAIR = 1 + 1e-12


def _rounded(df: DataFrame) -> DataFrame:
    """Nine significant digits (four for LOOSE), zero below 1e-12: sums of doubles depend on their order."""
    df = df.withColumn("value", F.when(F.abs("value") < 1e-12, 0.0).otherwise(F.col("value")))
    # a hair up, so that values that end in a five are rounded alike everywhere
    value = F.col("value") * HAIR
    shown = F.when(F.col("recipe").isin(*LOOSE), F.format_string("%.3e", value)).otherwise(F.format_string("%.8e", value))
    return df.withColumn("value", shown.cast("double")).withColumn("value", F.when(F.col("degenerate"), None).otherwise(F.col("value"))).drop("degenerate")


def _run(shape: Shape, ids: tuple[str, ...]) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        t = spark.read.parquet(f"{sf_dir}/{shape.table}.parquet")
        with lenient(spark):
            bound = spark.sql(shape.relation.replace(f"FROM {shape.table}", "FROM {source}"), source=t)
        return _rounded(evaluate(bound, ids, shape.params))

    return query


def _split(shape: Shape) -> tuple[tuple[str, ...], tuple[str, ...]]:
    finished = tuple(r for r in shape.recipes if not portable(catalogue.RECIPES[r]))
    return tuple(r for r in shape.recipes if r not in finished), finished


def queries() -> dict[str, Query]:
    out: dict[str, Query] = {}
    for s in _shapes():
        plain, finished = _split(s)
        if plain:
            out[f"metrics_{s.name}"] = _run(s, plain)
        if finished:
            out[f"tests_{s.name}"] = _run(s, finished)
    return out


def oracle_sql() -> dict[str, str]:
    out = {}
    for s in _shapes():
        for kind, ids in zip(("metrics", "tests"), _split(s), strict=True):
            if ids:
                value = f"CASE WHEN recipe IN ({', '.join(map(repr, LOOSE))}) THEN printf('%.3e', value * {HAIR!r}::DOUBLE) ELSE printf('%.8e', value * {HAIR!r}::DOUBLE) END"
                out[f"{kind}_{s.name}"] = f"SELECT g, recipe, CASE WHEN abs(value) < 1e-12 THEN 0 WHEN isfinite(value) THEN CAST({value} AS DOUBLE) END AS value FROM ({statement(s.relation, EXPECTED[s.name], ids)})"
    return out
