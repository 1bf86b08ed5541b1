"""Sources for pairs of categories and for ranks, shared by several families."""

from __future__ import annotations

from ..recipes import source


def contingency(a: str, b: str, name: str, text: bool = False) -> None:
    """Counts of pairs, with both margins and the total; and counts by class of either side."""
    x, y = (f"trim({a})", f"trim({b})") if text else (a, b)
    source(name, f"SELECT g, {x} AS a, {y} AS b, count(*) AS n FROM {{t}} c0 GROUP BY g, {x}, {y}")
    source(f"{name}_a", f"SELECT g, a, sum(n) AS na FROM {{{name}}} c1 GROUP BY g, a")
    source(f"{name}_b", f"SELECT g, b, sum(n) AS nb FROM {{{name}}} c1 GROUP BY g, b")
    source(f"{name}_n", f"SELECT g, sum(n) AS total, count(DISTINCT a) AS ka, count(DISTINCT b) AS kb FROM {{{name}}} c1 GROUP BY g")
    source(
        f"{name}_full",
        f"SELECT c.g, c.a, c.b, c.n, ca.na, cb.nb, cn.total, cn.ka, cn.kb FROM {{{name}}} c JOIN {{{name}_a}} ca ON c.g = ca.g AND c.a = ca.a JOIN {{{name}_b}} cb ON c.g = cb.g AND c.b = cb.b JOIN {{{name}_n}} cn ON c.g = cn.g",
    )
    source(
        f"{name}_classes",
        f"SELECT g, k, sum(t) AS t, sum(pr) AS pr, sum(hit) AS hit FROM (SELECT g, a AS k, n AS t, 0 AS pr, CASE WHEN a = b THEN n ELSE 0 END AS hit FROM {{{name}}} c1 "
        f"UNION ALL SELECT g, b AS k, 0 AS t, n AS pr, 0 AS hit FROM {{{name}}} c2) c3 GROUP BY g, k",
    )


#: Entropies in nats from the margins and cells of a full table.
MI = "sum(n / total * ln(n * total / (na * 1e0 * nb)))"
HA = "(-sum(n / total * ln(na / total)))"
HB = "(-sum(n / total * ln(nb / total)))"
HAB = "(-sum(n / total * ln(n / total)))"


def midranks(column: str, name: str, partition: str = "g", relation: str = "{t}") -> None:
    """Rows with ``rk``, the mean rank of the column among equals, and ``ties``, their number."""
    keys = [k.strip() for k in partition.split(",")]
    on = " AND ".join(f"z.{k} = m.{k}" for k in keys)
    source(f"{name}_counts", f"SELECT {partition}, {column} AS v, count(*) AS ties FROM {relation} r0 GROUP BY {partition}, {column}")
    source(
        f"{name}_ranks",
        f"SELECT {partition}, v, ties, sum(ties) OVER (PARTITION BY {partition} ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - (ties - 1) / 2e0 AS rk FROM {{{name}_counts}} r1",
    )
    source(name, f"SELECT z.*, m.rk, m.ties FROM {relation} z JOIN {{{name}_ranks}} m ON {on} AND z.{column} = m.v")
