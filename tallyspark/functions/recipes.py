"""Registry of recipes: metrics declared as SQL over a relation of named columns.

A recipe is a set of aggregate expressions over a source relation, grouped by the
key column ``g`` (one key for each call, series or group to recompute; a constant
where there is one only). Sources are derived relations written in plain SQL, such
as an equity curve or a table of counts. The expressions use what Spark SQL and
ANSI SQL share, so the same declaration serves Spark and, for checks, another
engine. All recipes of one source are computed in one pass.

Ordered sources use the column ``pos``; every window is partitioned by ``g``. Such a
source has a second form for series too long for one task: rows carry ``nth`` (place in
the key, from 0) and ``blk`` (block of ``{block}`` rows), windows stay in a block, and
states of the blocks before are carried over.

A finisher turns a recipe's aggregates into its value where SQL has no such
function (tails of distributions); it sees one row per key.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

Finisher = Callable[..., float | None]


@dataclass(frozen=True)
class Recipe:
    id: str
    family: str
    tags: tuple[str, ...]
    columns: tuple[str, ...]
    exprs: tuple[str, ...]
    source: str
    params: dict[str, str] = field(default_factory=dict)
    strings: frozenset[str] = frozenset()
    ordered: bool = False
    finish: str | None = None
    in_blocks: str = ""
    places: tuple[tuple[str, str], ...] = ()
    solver: str = ""

    def text(self, blocks: int = 0, **given: object) -> tuple[str, tuple[str, ...]]:
        """Source and expressions with the parameters filled in; ``blocks``: the form for blocks of so many rows."""
        unknown = given.keys() - self.params.keys()
        if unknown:
            raise ValueError(f"{self.id} has no parameter {', '.join(sorted(unknown))}")
        values = self.params | {k: _literal(v) for k, v in given.items()}
        values["block"] = str(blocks)
        fill = lambda s: re.sub(r"\{(\w+)\}", lambda m: values.get(m[1], m[0]), s)
        return fill(self.in_blocks if blocks and self.in_blocks else self.source), tuple(map(fill, self.exprs))


RECIPES: dict[str, Recipe] = {}
_SOURCES: dict[str, str] = {}
_IN_BLOCKS: dict[str, str] = {}
_ID = re.compile(r"^(\w+)(?:\[([^\]]*)\])?(?:\s*->\s*(\w+))?:\s")


def _literal(v: object) -> str:
    if isinstance(v, bool) or not isinstance(v, int | float | str):
        raise TypeError(f"a parameter is a number or a word, not {v!r}")
    if isinstance(v, str) and not re.fullmatch(r"[\w.+-]+", v):
        raise ValueError(f"not a plain parameter: {v!r}")
    return f"{v!r}e0" if isinstance(v, float) and "e" not in repr(v) else str(v)


def source(name: str, text: str, in_blocks: str = "") -> None:
    """Name a derived relation; ``{name}`` in later texts stands for it. ``in_blocks``: its form for series in blocks."""
    _SOURCES[name] = f"({expand(text.strip())})"
    _IN_BLOCKS[name] = f"({expand((in_blocks or text).strip(), _IN_BLOCKS)})"


SERIES = "PARTITION BY g ORDER BY pos"


def running(name: str, relation: str, keep: str, **states: str) -> None:
    """A source with running states in order of ``pos``: ``sum(...)`` or ``max(...)`` of all rows so far.

    In blocks, the state at a row is that of its block so far, joined to what the last
    rows of the blocks before it hold, added in the same order.
    """
    upto = "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
    plain = ", ".join(f"{e} OVER ({SERIES} {upto}) AS {c}" for c, e in states.items())
    inside = ", ".join(f"{e} OVER (PARTITION BY g, blk ORDER BY nth {upto}) AS {c}" for c, e in states.items())
    inside = f"SELECT g, blk, nth, {keep}, {inside} FROM {relation} {name}_r"
    last = ", ".join(f"max_by({c}, nth) AS {c}" for c in states)
    kinds = {c: e[: e.index("(")] for c, e in states.items()}
    before = ", ".join(f"{kinds[c]}({c}) OVER (PARTITION BY g ORDER BY blk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS {c}" for c in states)
    joined = ", ".join((f"coalesce(m.{c} + z.{c}, z.{c}, m.{c})" if kinds[c] == "sum" else f"greatest(m.{c}, z.{c})") + f" AS {c}" for c in states)
    kept = ", ".join(f"z.{c.strip()}" for c in keep.split(","))
    carried = f"SELECT g, blk, {before} FROM (SELECT g, blk, {last} FROM ({inside}) {name}_i GROUP BY g, blk) {name}_l"
    source(name, f"SELECT g, {keep}, {plain} FROM {relation} {name}_r", f"SELECT z.g, z.blk, z.nth, {kept}, {joined} FROM ({inside}) z JOIN ({carried}) m ON z.g = m.g AND z.blk = m.blk")


def nearby(name: str, relation: str, columns: str, before: str | int = 0, after: str | int = 0) -> None:
    """A source whose windows ``OVER ({W} ...)`` reach so many rows back and ahead in order of ``pos``, fewer than a block has.

    In blocks, the rows that close to its ends are copied to the next and the last block.
    """
    plain = columns.replace("{W}", SERIES)
    own = columns.replace("row_number() OVER ({W})", "(nth + 1)").replace("{W}", "PARTITION BY g, blk ORDER BY nth")
    row = lambda blk, where="": f"SELECT * EXCEPT (blk), {blk} AS blk, blk AS home FROM {relation} {name}_a{where}"
    rows = [row("blk")]
    if before:
        rows.append(row("blk + 1", f" WHERE nth % {{block}} >= {{block}} - ({before})"))
    if after:
        rows.append(row("blk - 1", f" WHERE blk > 0 AND nth % {{block}} < ({after})"))
    union = " UNION ALL ".join(rows)
    source(name, f"SELECT g, {plain} FROM {relation} {name}_r", f"SELECT * EXCEPT (home) FROM (SELECT g, blk, home, nth, {own} FROM ({union}) {name}_u) {name}_w WHERE home = blk")


def expand(text: str, names: dict[str, str] | None = None) -> str:
    names = _SOURCES if names is None else names
    for _ in range(8):
        new = re.sub(r"\{(\w+)\}", lambda m: names.get(m[1], m[0]), text)
        if new == text:
            return text
        text = new
    raise ValueError(f"a source refers to itself: {text[:80]}")


def with_totals(totals: str, relation: str = "{t}", name: str = "") -> str:
    """``relation`` with aggregates of itself by key, joined to each row."""
    body = f"SELECT z.*, {', '.join('m.' + c.rsplit(' AS ', 1)[1] for c in _split(totals))} FROM {relation} z JOIN (SELECT g, {totals} FROM {relation} k GROUP BY g) m ON z.g = m.g"
    if name:
        source(name, body)
    return f"({body})"


def _split(text: str, by: str = ",") -> list[str]:
    """Split at commas outside parentheses."""
    out, depth, last = [], 0, 0
    for k, c in enumerate(text):
        depth += (c == "(") - (c == ")")
        if c == by and not depth:
            out.append(text[last:k].strip())
            last = k + 1
    return [*out, text[last:].strip()]


def define(family: str, tags: str, body: str, source: str = "{t}", totals: str = "", ordered: bool = False, places: tuple[tuple[str, str], ...] = (), solver: str = "") -> None:
    """Register recipes, one to a line: ``id[param=default, ...] -> finisher: expr ;; expr``.

    places: columns that the source wants, each the row's place from 0 in an order of its key, as (name, expressions).
    solver: what computes the recipes in Spark instead of their source, see ``plans.solvers``.
    tags: the columns the recipes read, ``tag`` or ``tag=column``, a trailing ``'`` marking strings.
    """
    pairs = [t.strip().split("=") for t in tags.split(",") if t.strip()]
    names = tuple(p[0].rstrip("'") for p in pairs)
    columns = tuple(p[-1].rstrip("'") for p in pairs)
    strings = frozenset(p[-1].rstrip("'") for p in pairs if p[-1].endswith("'") or p[0].endswith("'"))
    relation = with_totals(totals, source) if totals else source
    lines: list[str] = []
    for line in body.strip().splitlines():
        line = line.strip()
        if not line or line.startswith("--"):
            continue
        if _ID.match(line):
            lines.append(line)
        else:
            lines[-1] += " " + line
    for line in lines:
        m = _ID.match(line)
        params = dict(p.strip().split("=") for p in _split(m[2])) if m[2] else {}
        if m[1] in RECIPES:
            raise ValueError(f"{m[1]} is registered twice")
        exprs = tuple(expand(e.strip()) for e in line[m.end() :].split(";;"))
        RECIPES[m[1]] = Recipe(m[1], family, names, columns, exprs, expand(relation), params, strings, ordered, m[3], expand(relation, _IN_BLOCKS) if ordered or places else "", places, solver)
