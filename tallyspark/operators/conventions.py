"""Conventions: the standard variants of a metric, tried in order.

A grid is a short list of parameter cells. All cells of a metric are computed in
one pass over the inputs (they share their aggregates), then the first whose value
is close to what was produced is taken, and only where the default disagrees.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.tolerance import close
from ..plans.evaluate import evaluate_cells

# The recognised variants, most usual first.
GRIDS: dict[str, list[tuple[str, dict[str, float | int]]]] = {
    "sharpe": [("catalog_sharpe", {"periods": p, "ddof": d}) for p in (1.0, 252.0, 260.0, 250.0, 52.0, 12.0, 4.0) for d in (1, 0)],
    "sortino": [("catalog_sortino", {"periods": p, "full": f}) for p in (1.0, 252.0, 52.0, 12.0) for f in (1, 0)],
    "calmar": [("catalog_calmar", {"periods": p}) for p in (252.0, 52.0, 12.0, 1.0)],
    "information_ratio": [("catalog_information_ratio", {"periods": p, "ddof": d}) for p in (1.0, 252.0, 52.0, 12.0) for d in (1, 0)],
    "stdev": [("catalog_stdev", {"ddof": d}) for d in (1, 0)],
    "variance": [("catalog_variance", {"ddof": d}) for d in (1, 0)],
    "correlation": [("catalog_correlation", {}), ("catalog_correlation_spearman", {}), ("catalog_correlation_kendall", {})],
    "ndcg": [("catalog_ndcg", {"exponential": e, "k": k}) for e in (0, 1) for k in (0, 5, 10, 20)],
}
#: Sources of the variants and parameters that no grid may vary.
SOURCES = {m: "published definitions of the metric and the defaults of common libraries" for m in GRIDS}
FORBIDDEN = {"sharpe": ("rf",), "sortino": ("rf",), "information_ratio": ("rf",)}
LARGEST = 24


def violations() -> list[str]:
    """What is wrong with the grids; empty if nothing is."""
    out = []
    for metric, cells in GRIDS.items():
        if not 0 < len(cells) <= LARGEST:
            out.append(f"{metric}: {len(cells)} cells")
        if len({(r, tuple(sorted(p.items()))) for r, p in cells}) < len(cells):
            out.append(f"{metric}: a cell occurs twice")
        out += [f"{metric}: {p} may not vary" for p in FORBIDDEN.get(metric, ()) if any(p in c for _, c in cells)]
        if metric not in SOURCES:
            out.append(f"{metric}: no source")
    return out


def cells(inputs: DataFrame, metric: str, key: str = "call_id", bind: dict[str, str] | None = None) -> DataFrame:
    """Rows (g, cell, convention, value): every variant of the metric for each call, from one pass for each source relation."""
    grid = GRIDS[metric]
    found = evaluate_cells(inputs, [(str(n), recipe, params) for n, (recipe, params) in enumerate(grid)], key, bind)
    names = F.array(*[F.lit(str(params)) for _, params in grid])
    return found.withColumn("cell", F.col("recipe").cast("int")).select("g", "cell", F.get(names, F.col("cell")).alias("convention"), "value")


def search(produced: DataFrame, found: DataFrame) -> DataFrame:
    """The first variant that reproduces a call's value: (g, cell, convention, value).

    produced: g, produced; found: as by ``cells``.
    """
    near = found.join(produced, "g").where(close(F.col("value"), F.col("produced")))
    return near.groupBy("g").agg(F.min_by(F.struct("cell", "convention", "value"), "cell").alias("x")).select("g", "x.*")
