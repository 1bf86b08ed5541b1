"""Recipes whose SQL lists pairs or windows of rows, computed in Arrow batches of numpy instead.

A recipe names its solver (``define(..., solver=...)``); its source stays the definition.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .storage import written

#: Pairs, or rows, between two slopes that are gone through one by one; slopes held at once.
FEW, CELLS = 128, 1 << 20


def _smaller_before(ranks: np.ndarray) -> np.ndarray:
    """For each entry of a permutation of 0 to n - 1, how many smaller ones come before it: by bits, from the highest."""
    n = len(ranks)
    at, now, out, place = np.arange(n), ranks, np.zeros(n, np.int64), np.arange(n)
    for b in range(max(int(n - 1).bit_length() - 1, 0), -1, -1):
        # ranks alike above the bit stand together, in their old order
        begin = now >> (b + 1) << (b + 1)
        one = (now >> b & 1).astype(bool)
        zeros = np.concatenate(([0], np.cumsum(~one)))
        before = zeros[at] - zeros[begin]
        out[place[one]] += before[one]
        to = begin + np.where(one, (1 << b) + at - begin - before, before)
        moved, places = np.empty_like(now), np.empty_like(place)
        moved[to], places[to] = now, place
        now, place = moved, places
    return out


class Slopes:
    """Slopes between the rows of different x of one key, by counts instead of a list."""

    def __init__(self, x: np.ndarray, y: np.ndarray) -> None:
        order = np.lexsort((y, x))
        self.x, self.y = x[order], y[order]
        self.others = len(x) - (np.searchsorted(self.x, self.x, "right") - np.searchsorted(self.x, self.x, "left"))
        self.plain = not (np.isfinite(x).all() and np.isfinite(y).all())

    def of(self, i: int) -> np.ndarray:
        apart = self.x != self.x[i]
        return (self.y[apart] - self.y[i]) / (self.x[apart] - self.x[i])

    def upto(self, t: float) -> np.ndarray:
        """For each row, how many slopes to others are ``t`` at most."""
        if self.plain:
            return np.array([np.count_nonzero(self.of(i) <= t) for i in range(len(self.x))], np.int64)
        # a later row is no steeper if its height over a line of slope t is no greater
        with np.errstate(over="ignore"):
            z = self.y - t * self.x
        order = np.lexsort((z, self.x))
        zs, xs = z[order], self.x[order]
        ranks = np.empty(len(z), np.int64)
        ranks[np.lexsort((-xs, zs))] = np.arange(len(z))
        less = _smaller_before(ranks)
        out = np.empty(len(z), np.int64)
        out[order] = np.arange(len(z)) - less + ranks - less
        return out


def _ordered(v: float) -> int:
    """Doubles in whole numbers of the same order."""
    k = int(np.float64(v).view(np.int64))
    return k if k >= 0 else -(k & 0x7FFFFFFFFFFFFFFF)


def _double(k: int) -> float:
    return float(np.int64(k).view(np.float64)) if k >= 0 else -float(np.int64(-k).view(np.float64))


def _between(lo: float, hi: float, rng: np.random.Generator) -> float | None:
    """A value about the middle of the doubles inside an interval, none if it has none."""
    a, b = _ordered(lo), _ordered(hi)
    return _double(min(max(a + int((b - a) * rng.uniform(0.4, 0.6)), a + 1), b - 1)) if b - a > 1 else None


def _middle(values: np.ndarray) -> float:
    """The median, as of ``percentile(v, 0.5)``."""
    k = (len(values) - 1) // 2
    part = np.partition(values, [k, len(values) // 2])
    return float(part[k] if len(values) % 2 else (part[k] + part[len(values) // 2]) / 2)


def _sampled(s: Slopes, place: float, rng: np.random.Generator) -> tuple[float, float]:
    """Values that are likely to hold a place (as a share) of the slopes."""
    i, j = rng.integers(0, len(s.x), (2, 200_000))
    apart = s.x[i] != s.x[j]
    with np.errstate(all="ignore"):
        some = (s.y[i] - s.y[j])[apart] / (s.x[i] - s.x[j])[apart]
    some = some[np.isfinite(some)]
    if not len(some):
        return -1.0, 1.0
    lo, hi = np.quantile(some, np.clip([place - 0.01, place + 0.01], 0, 1))
    # beside the slopes that occur, since rounding decides at those
    aside = rng.uniform(0.01, 0.02) * max(hi - lo, 1e-6 * max(abs(lo), abs(hi)))
    return float(lo - aside), float(hi + aside)


def _slope_at(s: Slopes, place: int, rng: np.random.Generator) -> float:
    """The slope at a place from 0 of all of them in ascending order."""
    total = int(s.others.sum()) // 2
    lo, hi = -np.inf, np.inf
    below, upto = np.zeros(len(s.x), np.int64), s.others
    tries = list(_sampled(s, place / max(total - 1, 1), rng))
    while True:
        held = (int(upto.sum()) - int(below.sum())) // 2
        t = None if held <= FEW else next((t for t in tries if lo < t < hi), None)
        if t is None and held > FEW:
            t = _between(lo, hi, rng)
        tries = [x for x in tries if x != t]
        if t is None:
            break
        c = s.upto(t)
        if int(c.sum()) // 2 <= place:
            lo, below = t, c
        else:
            hi, upto = t, c
    found: list[np.ndarray] = []
    k, size = place - int(below.sum()) // 2, 0
    for i in np.flatnonzero(upto > below):
        # each pair once, from its row of smaller x
        right = np.searchsorted(s.x, s.x[i], "right")
        v = (s.y[right:] - s.y[i]) / (s.x[right:] - s.x[i])
        found.append(v[(v > lo) & ((v <= hi) | np.isnan(v) & (hi == np.inf))])
        size += len(found[-1])
        if size > CELLS:  # doubles next to each other, apart by rounding
            break
    inside = np.sort(np.concatenate(found)) if found else np.array([])
    return float(inside[min(max(k, 0), len(inside) - 1)]) if len(inside) else hi


def theil_sen(x: np.ndarray, y: np.ndarray) -> float | None:
    """Median of the slopes of all pairs."""
    s, rng = Slopes(x, y), np.random.default_rng(1)
    n = int(s.others.sum()) // 2
    if not n:
        return None
    low = _slope_at(s, (n - 1) // 2, rng)
    return low if n % 2 else (low + _slope_at(s, n // 2, rng)) / 2


def repeated_median(x: np.ndarray, y: np.ndarray) -> float | None:
    """Median over rows of the median of a row's slopes."""
    s, rng = Slopes(x, y), np.random.default_rng(1)
    rows = np.flatnonzero(s.others > 0)
    if not len(rows):
        return None
    m = s.others[rows]
    low, high = (m - 1) // 2, m // 2
    places = {(len(rows) - 1) // 2, len(rows) // 2}
    lo, hi, unsure = -np.inf, np.inf, []
    under, over = np.zeros(len(rows), bool), np.zeros(len(rows), bool)  # medians below the middle; above it
    tries = [] if s.plain else list(_sampled(s, 0.5, rng))
    few = FEW
    while not s.plain and np.count_nonzero(~under & ~over) > few:
        t = next((t for t in tries if lo < t < hi), None)
        tries = [v for v in tries if v != t]
        if t is None:
            # beyond values that are unsure, since rows have two middle slopes
            wide = [(lo, min(unsure)), (max(unsure), hi)] if unsure else [(lo, hi)]
            t = next((t for t in (_between(*w, rng) for w in sorted(wide, key=lambda w: _ordered(w[0]) - _ordered(w[1]))) if t is not None), None)
        if t is None:
            break
        c = s.upto(t)[rows]
        sure_under, sure_over = c > high, c <= low
        if len(rows) - np.count_nonzero(sure_over) <= min(places):
            lo, under = t, sure_under
        elif np.count_nonzero(sure_under) > max(places):
            hi, over = t, sure_over
        else:
            unsure.append(t)
            few = max(few, 2 * np.count_nonzero(~sure_under & ~sure_over))
    kept = rows[~under & ~over]
    with np.errstate(all="ignore"):
        middles = np.sort([_middle(s.of(i)) for i in kept])
    first = int(np.count_nonzero(under))
    found = [float(middles[min(max(p - first, 0), len(middles) - 1)]) for p in sorted(places)]
    return sum(found) / len(found)


def by_key(rows: DataFrame, columns: list[str], f: Callable[..., float | None], ordered: bool = False) -> DataFrame:
    """Rows (g, value) of a function of a key's columns, in order of ``pos`` if asked for, which are held in one task."""
    kind = dict(rows.dtypes)["g"]

    def run(key: tuple, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        whole = pd.concat(list(batches))
        whole = whole.sort_values("pos") if ordered else whole
        parts = [whole[c].to_numpy(dtype="float64", na_value=np.nan) for c in columns]
        value = None if any(np.isnan(v).any() for v in parts) else f(*parts)
        yield pd.DataFrame({"g": pd.Series([key[0]], dtype=object), "value": pd.Series([value], dtype="float64")})

    return rows.select("g", *columns, *(["pos"] if ordered else [])).groupBy("g").applyInPandas(run, f"g {kind}, value double")


#: Windows of the rescaled range, in rows; a long key is dealt out in stretches of one of these sizes.
WINDOWS = [8 << j for j in range(24)]
STRETCH = WINDOWS[15]


def _ranges(x: np.ndarray, w: int) -> np.ndarray:
    """Rescaled ranges of the whole windows of ``w`` rows; those of equal values have none."""
    rows = x[: len(x) // w * w].reshape(-1, w)
    rows = rows[rows.max(1) > rows.min(1)]
    s = np.cumsum(rows - rows.mean(1, keepdims=True), 1)
    with np.errstate(all="ignore"):
        return (np.maximum(s.max(1), 0) - np.minimum(s.min(1), 0)) / rows.std(1)


def _exponent(sizes: list[int], means: list[float]) -> float | None:
    """Slope of log mean against log size."""
    held = [(np.log(w), np.log(m)) for w, m in zip(sizes, means, strict=True) if m > 0]
    if len(held) < 2:
        return None
    u, v = (np.array(c) - np.mean(c) for c in zip(*held, strict=True))
    return float((u * v).sum() / (u * u).sum())


def hurst(x: np.ndarray) -> float | None:
    sizes, means = [], []
    for w in WINDOWS:
        found = _ranges(x, w) if w <= len(x) / 2 else np.array([])
        if len(found):
            sizes.append(w)
            means.append(float(found.mean()))
    return _exponent(sizes, means)


def hurst_in_blocks(rows: DataFrame, stretch: int | None = None) -> DataFrame:
    """As ``hurst`` for rows with ``nth``: a key is dealt out in stretches; windows of more take their means from all of theirs first."""
    kind = dict(rows.dtypes)["g"]
    stretch = stretch or STRETCH
    small, large = [w for w in WINDOWS if w <= stretch], [w for w in WINDOWS if w > stretch]
    dealt = rows.select("g", "nth", F.col("x").cast("double").alias("x"), F.expr(f"nth DIV {stretch}").alias("part"))

    def within(key: tuple, b: pd.DataFrame) -> pd.DataFrame:
        x = b.sort_values("nth")["x"].to_numpy(dtype="float64", na_value=np.nan)
        found = [_ranges(x, w) for w in small]
        mean = float(x.mean())
        return pd.DataFrame({"g": pd.Series([key[0]], dtype=object), "part": [key[1]], "n": [len(x)], "mean": [mean], "squares": [float(((x - mean) ** 2).sum())], "low": [float(x.min())], "high": [float(x.max())],
                             "ranges": [[float(f.sum()) for f in found]], "windows": [[len(f) for f in found]]})

    schema = f"g {kind}, part long, n long, mean double, squares double, low double, high double, ranges array<double>, windows array<long>"
    parts = written(dealt.groupBy("g", "part").applyInPandas(within, schema), "stretches")
    sizes = parts.groupBy("g").agg(F.sum("n").alias("rows"))
    inside = parts.select("g", F.posexplode(F.arrays_zip("ranges", "windows")).alias("j", "z")).groupBy("g", "j").agg(F.sum("z.ranges").alias("s"), F.sum("z.windows").alias("c"))
    inside = inside.select("g", F.expr("shiftleft(8L, j)").alias("w"), "s", "c") if small else None
    # whole windows of several stretches
    each = parts.select("*", F.explode(F.array(*[F.lit(w).cast("long") for w in large])).alias("w")).withColumn("b", F.expr(f"part DIV (w DIV {stretch})"))
    whole = each.groupBy("g", "w", "b").agg(F.sum("n").alias("m"), (F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("mu"), F.min("low").alias("low"), F.max("high").alias("high")).where("m = w AND high > low")
    same = lambda l, r: F.col(f"{l}.g").eqNullSafe(F.col(f"{r}.g"))
    mine = each.alias("e").join(whole.alias("k"), same("e", "k") & (F.col("e.w") == F.col("k.w")) & (F.col("e.b") == F.col("k.b")))
    mine = written(mine.select("e.g", "e.part", "e.w", "e.b", "k.mu", (F.col("e.squares") + F.col("e.n") * F.pow(F.col("e.mean") - F.col("k.mu"), F.lit(2))).alias("about")), "windows")

    def along(key: tuple, b: pd.DataFrame, of: pd.DataFrame) -> pd.DataFrame:
        x = b.sort_values("nth")["x"].to_numpy(dtype="float64", na_value=np.nan)
        walks = [np.cumsum(x - mu) for mu in of["mu"]] if len(x) else []
        of = of if len(x) else of[:0]
        return pd.DataFrame({"g": of["g"].astype(object), "part": of["part"], "w": of["w"], "b": of["b"], "about": of["about"], "top": [float(s.max()) for s in walks], "bottom": [float(s.min()) for s in walks], "last": [float(s[-1]) for s in walks]})

    walked = dealt.groupBy("g", "part").cogroup(mine.groupBy("g", "part")).applyInPandas(along, f"g {kind}, part long, w long, b long, about double, top double, bottom double, last double")
    before = F.coalesce(F.sum("last").over(Window.partitionBy("g", "w", "b").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    moved = walked.select("g", "w", "b", "about", (before + F.col("top")).alias("top"), (before + F.col("bottom")).alias("bottom"))
    ranges = moved.groupBy("g", "w", "b").agg((F.greatest(F.max("top"), F.lit(0.0)) - F.least(F.min("bottom"), F.lit(0.0))).alias("range"), F.sqrt(F.sum("about") / F.first("w")).alias("sd"))
    above = ranges.groupBy("g", "w").agg(F.sum(F.col("range") / F.col("sd")).alias("s"), F.count(F.lit(1)).alias("c"))
    every = (inside.unionByName(above) if inside is not None else above).alias("a").join(sizes.alias("n"), same("a", "n")).where("a.w <= n.rows / 2 AND a.c > 0 AND a.s > 0")
    logs = every.select("a.g", F.log(F.col("a.w")).alias("u"), F.log(F.col("a.s") / F.col("a.c")).alias("v"))
    return logs.groupBy("g").agg(F.expr("CASE WHEN count(*) > 1 THEN covar_pop(u, v) / var_pop(u) END").alias("value"))


def neutral_corr(rows: DataFrame) -> DataFrame:
    """The finisher of that name, an era a task instead of a key's rows in lists."""
    from ..functions.finishers import FINISHERS

    kind, one = dict(rows.dtypes)["g"], FINISHERS["neutral_corr"]
    columns = ["p", "target", "f1", "f2"]

    def run(key: tuple, b: pd.DataFrame) -> pd.DataFrame:
        values = [b[c].to_numpy(dtype="float64", na_value=np.nan) for c in columns]
        bad = any(np.isnan(v).any() for v in values)
        try:
            value = None if bad or len(b) < 2 else one([""] * len(b), *values)
        except (ArithmeticError, ValueError):
            bad, value = True, None
        return pd.DataFrame({"g": pd.Series([key[0]], dtype=object), "era": pd.Series([key[1]], dtype=object), "counts": [bad or len(b) > 1], "value": pd.Series([value], dtype="float64")})

    eras = rows.select("g", "era", *columns).groupBy("g", "era").applyInPandas(run, f"g {kind}, era string, counts boolean, value double")
    # an era without a value leaves its key without one
    return eras.where("counts").groupBy("g").agg(F.expr("CASE WHEN count(value) = count(*) THEN avg(value) END").alias("value"))


#: Rows (g, value) of a recipe from rows (g, its columns, pos; nth for long keys).
SOLVERS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "theil_sen": lambda rows: by_key(rows, ["x", "y"], theil_sen),
    "hurst": lambda rows: hurst_in_blocks(rows) if "nth" in rows.columns else by_key(rows, ["x"], hurst, ordered=True),
    "neutral_corr": neutral_corr,
    "repeated_median": lambda rows: by_key(rows, ["x", "y"], repeated_median),
}
