"""Pairs of rows counted and summed without listing them.

Rows have two places: ``nx`` in one order, ``ny`` in another (``define(..., places=...)``),
each a permutation of 0 to n - 1 within the key. For every pair with nx and ny both
smaller, the highest bit in which their ny differ is 0 in the smaller one: at each bit,
among rows whose ny agree above it, a row with a 1 meets the rows with a 0 that come before
it by nx. So sums over all such pairs are running sums over rows, once a bit: n log n in all.

Groups of few bits have few rows. For long series, groups of more than ``SMALL`` bits
are cut into stretches of nx, which take on the sums of the stretches before.
"""

from ..recipes import source

#: Groups of up to 2 ** SMALL rows are one window.
SMALL = 18

source("key_sizes", "SELECT g, count(*) AS n FROM {t} k0 GROUP BY g")


def below(name: str, totals: str, relation: str = "{t}", **sums: str) -> None:
    """A row for each key: ``totals`` over the rows, each seen once for every group of pairs that it is the larger of; ``sums`` over the smaller ones."""
    bits = (f"(SELECT z.*, b, shiftright(z.ny, b + 1) AS above, shiftright(z.ny, b) % 2 AS bit FROM (SELECT z.*, m.n AS rows_of_key FROM {relation} z JOIN {{key_sizes}} m ON z.g = m.g) z "
            "LATERAL VIEW explode(sequence(0, greatest(CAST(ceil(log2(z.rows_of_key)) AS INT) - 1, 0))) e AS b)")
    upto = "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
    running = lambda by: ", ".join(f"sum(CASE WHEN bit = 0 THEN {e} ELSE 0 END) OVER (PARTITION BY {by} ORDER BY nx {upto}) AS {c}" for c, e in sums.items())
    plain = f"SELECT *, {running('g, b, above')} FROM {bits} z0"
    few = f"SELECT *, {running('g, b, above')} FROM {bits} z0 WHERE b < {SMALL}"
    many = f"(SELECT *, shiftright(nx, {SMALL}) AS stretch FROM {bits} z1 WHERE b >= {SMALL})"
    inside = f"SELECT *, {running('g, b, above, stretch')} FROM {many} z2"
    each = ", ".join(f"sum(CASE WHEN bit = 0 THEN {e} ELSE 0 END) AS {c}" for c, e in sums.items())
    before = ", ".join(f"sum({c}) OVER (PARTITION BY g, b, above ORDER BY stretch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS {c}" for c in sums)
    carried = f"SELECT g, b, above, stretch, {before} FROM (SELECT g, b, above, stretch, {each} FROM {many} z3 GROUP BY g, b, above, stretch) z4"
    joined = ", ".join(f"z.{c} + coalesce(m.{c}, 0) AS {c}" for c in sums)
    stretched = f"SELECT z.* EXCEPT (stretch, {', '.join(sums)}), {joined} FROM ({inside}) z JOIN ({carried}) m ON z.g = m.g AND z.b = m.b AND z.above = m.above AND z.stretch = m.stretch"
    whole = lambda rows: f"SELECT g, {totals} FROM ({rows}) z5 WHERE bit = 1 GROUP BY g"
    source(name, whole(plain), whole(f"{few} UNION ALL {stretched}"))


def tied(columns: str, weight: str = "count(*)") -> str:
    """Pairs of rows alike in the columns, for each key."""
    return f"SELECT g, sum(k * 1e0 * (k - 1) / 2) AS pairs FROM (SELECT g, {columns}, {weight} AS k FROM {{t}} k1 GROUP BY g, {columns}) k2 GROUP BY g"


# pairs of (x, y): places by x, then y, and by y, then place; so pairs with a tie count as in order
below("ordered_pairs", "sum(c) AS up", c="1e0")
source("tied_x", tied("x"))
source("tied_y", tied("y"))
source("tied_xy", tied("x, y"))
source("concordance", "SELECT s.g, coalesce(p.up, 0) - tx.pairs - ty.pairs + txy.pairs AS con, s.n * 1e0 * (s.n - 1) / 2 - coalesce(p.up, 0) AS dis, s.n * 1e0 * (s.n - 1) / 2 - tx.pairs AS apart_x, s.n * 1e0 * (s.n - 1) / 2 - ty.pairs AS apart_y, "
       "ty.pairs - txy.pairs AS only_y FROM {key_sizes} s JOIN {tied_x} tx ON s.g = tx.g JOIN {tied_y} ty ON s.g = ty.g JOIN {tied_xy} txy ON s.g = txy.g LEFT JOIN {ordered_pairs} p ON s.g = p.g")
IN_PLACE = (("nx", "x, y"), ("ny", "y, nx"))

# sum of |xi - xj| |yi - yj| over pairs: (xi - xj)(yi - yj), twice where both orders agree, less once for all pairs
source("about_mean", "SELECT z.g, z.nx, z.ny, z.x - m.mx AS x, z.y - m.my AS y FROM {t} z JOIN (SELECT g, avg(x) AS mx, avg(y) AS my FROM {t} k3 GROUP BY g) m ON z.g = m.g")
below("agreeing", "sum(x * y * c - x * sy - y * sx + sxy) AS prod", "{about_mean}", c="1e0", sx="x", sy="y", sxy="x * y")


def _row_sums(c: str) -> str:
    """Sum of the distances of a row's value from all others, by running sums over distinct values."""
    upto = "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
    counts = f"SELECT g, {c}, count(*) AS k FROM {{about_mean}} k4 GROUP BY g, {c}"
    running = f"SELECT g, {c}, sum(k) OVER (PARTITION BY g ORDER BY {c} {upto}) AS upto, sum(k * {c}) OVER (PARTITION BY g ORDER BY {c} {upto}) AS held FROM ({counts}) k5"
    return f"SELECT q.g, q.{c}, {c} * (2e0 * q.upto - m.n) + m.s - 2 * q.held AS away FROM ({running}) q JOIN (SELECT g, count(*) AS n, sum({c}) AS s FROM {{about_mean}} k6 GROUP BY g) m ON q.g = m.g"


source("away_x", _row_sums("x"))
source("away_y", _row_sums("y"))
source("away", "SELECT z.g, z.x, z.y, u.away AS ax, v.away AS ay FROM {about_mean} z JOIN {away_x} u ON z.g = u.g AND z.x = u.x JOIN {away_y} v ON z.g = v.g AND z.y = v.y")
source("away_sums", "SELECT g, count(*) * 1e0 AS n, sum(ax) AS tx, sum(ay) AS ty, sum(ax * ay) AS xy, sum(ax * ax) AS xx, sum(ay * ay) AS yy, "
       "count(*) * sum(x * y) - sum(x) * sum(y) AS cross_xy, count(*) * sum(x * x) - sum(x) * sum(x) AS cross_xx, count(*) * sum(y * y) - sum(y) * sum(y) AS cross_yy FROM {away} k7 GROUP BY g")
DCOV = lambda total, a, b, ab: f"({total} / (n * n) - 2 * {ab} / (n * n * n) + {a} * {b} / (n * n * n * n))"
source("distance_sums", f"SELECT s.g, {DCOV('2 * (2 * coalesce(p.prod, 0) - s.cross_xy)', 'tx', 'ty', 'xy')} AS vxy, {DCOV('2 * s.cross_xx', 'tx', 'tx', 'xx')} AS vxx, {DCOV('2 * s.cross_yy', 'ty', 'ty', 'yy')} AS vyy "
       "FROM {away_sums} s LEFT JOIN {agreeing} p ON s.g = p.g")

# durations and scores: pairs of an event and a later row; those of a higher score, and those of at least the same
below("scored_above", "sum(c) AS pairs", c="CASE WHEN ev = 1 THEN 1e0 ELSE 0e0 END")
source("by_other_place", "SELECT g, ev, nx, nz AS ny FROM {t} k12")
below("scored_as_high", "sum(c) AS pairs", "{by_other_place}", c="CASE WHEN ev = 1 THEN 1e0 ELSE 0e0 END")
source("alike_events", "SELECT g, sum(k * 1e0 * (k - 1) / 2) AS pairs FROM (SELECT g, d, sc, count_if(ev = 1) AS k FROM {t} k8 GROUP BY g, d, sc) k9 GROUP BY g")
source("later_rows", "SELECT g, sum(k * 1e0 * (n - upto)) AS pairs FROM (SELECT z.g, z.k, m.n, sum(z.c) OVER (PARTITION BY z.g ORDER BY z.d ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM "
       "(SELECT g, d, count(*) AS c, count_if(ev = 1) AS k FROM {t} k10 GROUP BY g, d) z JOIN {key_sizes} m ON z.g = m.g) k11 GROUP BY g")
source("ranked_events", "SELECT l.g, (coalesce(p.pairs, 0) + coalesce(q.pairs, 0) - a.pairs) / 2 AS wins, l.pairs FROM {later_rows} l JOIN {alike_events} a ON l.g = a.g LEFT JOIN {scored_above} p ON l.g = p.g LEFT JOIN {scored_as_high} q ON l.g = q.g")
# rows of one time have falling scores, events last: not counted but for pairs of events alike; ties of score have falling or rising places
EVENT_PLACES = (("nx", "d, -sc, ev"), ("ny", "sc, -nx"), ("nz", "sc, nx"))
