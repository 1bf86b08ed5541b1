"""Expected values of the recipes in DuckDB SQL, written from the definitions.

They share no text with the recipes: a key's columns are gathered into lists, and
metrics are sums over positions of those lists, with ranks, runs and pairs from
window functions of their own. ``$x`` in a term stands for ``x[i]``.

A shape has columns (gathered in order of ``pos``), window columns computed before,
further one-row-a-key relations joined by ``g``, layers of derived columns, and the
metrics themselves, ``id: expression`` a line.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field


def at(term: str) -> str:
    return re.sub(r"\$(\w+)", r"\1[i]", term)


def over(where: str = "") -> str:
    return f"list_filter(places, lambda i: {at(where)})" if where else "places"


def each(term: str, where: str = "") -> str:
    """The term at every position, or at those that satisfy ``where``."""
    return f"list_transform({over(where)}, lambda i: ({at(term)})::DOUBLE)"


def total(term: str, where: str = "") -> str:
    return f"list_sum({each(term, where)})"


def mean(term: str, where: str = "") -> str:
    return f"list_avg({each(term, where)})"


def top(term: str, where: str = "") -> str:
    return f"list_max({each(term, where)})"


def low(term: str, where: str = "") -> str:
    return f"list_min({each(term, where)})"


def count(where: str) -> str:
    return f"len({over(where)})::DOUBLE"


def spread(term: str, where: str = "", how: str = "stddev_samp") -> str:
    return f"list_{how}({each(term, where)})"


def share(where: str) -> str:
    return f"({count(where)} / n)"


def quantile(ordered: str, q: float | str) -> str:
    """Linear interpolation between the neighbours of place q * (n - 1) of a sorted list."""
    size = f"len({ordered})"
    place = f"(({q}) * ({size} - 1))"
    whole = f"floor({place} + 1e-9)::BIGINT"
    return f"({ordered}[{whole} + 1] + ({place} - {whole}) * ({ordered}[least({whole} + 2, {size})] - {ordered}[{whole} + 1]))"


@dataclass(frozen=True)
class Expected:
    columns: str
    metrics: str
    windows: tuple[str, ...] = ()
    relations: tuple[str, ...] = ()
    layers: tuple[dict[str, str], ...] = field(default=())
    start: str = "base"

    def lines(self) -> dict[str, str]:
        out: dict[str, str] = {}
        for line in self.metrics.strip().splitlines():
            name, expr = line.strip().split(": ", 1)
            out[name] = expr
        return out


def statement(relation: str, shape: Expected, ids: tuple[str, ...]) -> str:
    """Rows (g, recipe, value) for the recipes of a shape."""
    known = shape.lines()
    parts, last = [f"base AS ({relation})"], "base"
    for k, columns in enumerate(shape.windows):
        parts.append(f"w{k} AS (SELECT *, {columns} FROM {last})")
        last = f"w{k}"
    # the same names serve the relations, which may need ranks and runs too
    parts.append(f"rows_ AS (SELECT * FROM {last})")
    gathered = ", ".join(f"list({c} ORDER BY pos) AS {c}" for c in shape.columns.split())
    order = "" if re.search(r"\bpos\b", relation) else "0 AS pos, "
    parts.append(f"m0 AS (SELECT g, {gathered}, count(*)::DOUBLE AS n, range(1, count(*) + 1) AS places FROM (SELECT {order}* FROM rows_) GROUP BY g)")
    last = "m0"
    for k, text in enumerate(shape.relations):
        parts.append(f"x{k} AS ({text})")
        parts.append(f"j{k} AS (SELECT * FROM {last} LEFT JOIN x{k} USING (g))")
        last = f"j{k}"
    for k, layer in enumerate(shape.layers, 1):
        parts.append(f"m{k} AS (SELECT *, {', '.join(f'{e} AS {name}' for name, e in layer.items())} FROM {last})")
        last = f"m{k}"
    values = ", ".join(f"({known[i]})::DOUBLE AS v{k}" for k, i in enumerate(ids))
    parts.append(f"wide AS MATERIALIZED (SELECT g, {values} FROM {last})")
    return f"WITH {', '.join(parts)} " + " UNION ALL ".join(f"SELECT g, '{i}' AS recipe, v{k} AS value FROM wide" for k, i in enumerate(ids))


def rank_of(column: str, partition: str = "g") -> str:
    """Mean rank among equals."""
    return f"rank() OVER (PARTITION BY {partition} ORDER BY {column}) + (count(*) OVER (PARTITION BY {partition}, {column}) - 1) / 2"


PI = "3.141592653589793"


def let(name: str, value: str, body: str) -> str:
    """The body with a value computed once under a name."""
    return f"list_transform([({value})::DOUBLE], lambda {name}: {body})[1]"


def upper_tail(z: str) -> str:
    """Chance of a standard normal above ``z`` >= 0: a series near zero, a continued fraction beyond."""
    series = f"list_sum(list_transform(range(60), lambda k: CASE WHEN zz > 0 THEN exp((2 * k + 1) * ln(zz) - (k + 1) * ln(2) - lgamma(k + 1.5) + ln({PI}) / 2) ELSE 0 END))"
    fraction = "list_reduce(list_prepend(zz, list_transform(range(80, 0, -1), lambda k: k::DOUBLE)), lambda below, k: zz + k / below)"
    return let("zz", z, f"CASE WHEN zz < 3 THEN 0.5 - exp(-zz * zz / 2) / sqrt(2 * {PI}) * {series} ELSE exp(-zz * zz / 2) / sqrt(2 * {PI}) / {fraction} END")


def normal(z: str) -> str:
    """Distribution function of the standard normal."""
    return let("z0", z, f"CASE WHEN z0 > 0 THEN 1 - {upper_tail('abs(z0)')} ELSE {upper_tail('abs(z0)')} END")


def normal_quantile(p: str) -> str:
    """Its inverse: a rational start (Abramowitz and Stegun 26.2.23), then Newton steps."""
    begin = "t0 - (2.515517 + 0.802853 * t0 + 0.010328 * t0 * t0) / (1 + 1.432788 * t0 + 0.189269 * t0 * t0 + 0.001308 * t0 * t0 * t0)"
    step = lambda x: f"{x} + ({upper_tail(x)} - q0) * sqrt(2 * {PI}) * exp({x} * {x} / 2)"
    body = let("x1", begin, let("x2", step("x1"), let("x3", step("x2"), f"sign(p0 - 0.5) * ({step('x3')})")))
    return let("p0", p, let("q0", "least(p0, 1 - p0)", let("t0", "sqrt(-2 * ln(q0))", f"CASE WHEN p0 = 0.5 THEN 0 ELSE {body} END")))


def chi_square_tail(x: str, df: str) -> str:
    """Chance of more than ``x``, for whole degrees of freedom: finite sums."""
    even = "list_sum(list_transform(range((d0 / 2)::BIGINT), lambda j: CASE WHEN h0 > 0 THEN exp(j * ln(h0) - h0 - lgamma(j + 1)) ELSE (j = 0)::INT END))"
    odd = f"2 * {upper_tail('sqrt(2 * h0)')} + coalesce(list_sum(list_transform(range(1, ((d0 + 1) / 2)::BIGINT), lambda j: exp((j - 0.5) * ln(h0) - h0 - lgamma(j + 0.5)))), 0)"
    return let("h0", f"greatest(({x}) / 2, 0)", let("d0", df, f"CASE WHEN d0 % 2 = 0 THEN {even} ELSE {odd} END"))


def student_tail(t: str, df: str) -> str:
    """Chance of more than ``t`` >= 0 on either side: Simpson's rule over the angle atan(t / sqrt(df))."""
    begin, steps = "atan(u0 / sqrt(d1))", 4000
    end = f"CASE WHEN d1 < 200 THEN {PI} / 2 ELSE atan((u0 + 40 / (u0 + 4.5)) / sqrt(d1)) END"
    weight = f"CASE WHEN k = 0 OR k = {steps} THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END"
    height = f"(CASE WHEN cos(a0 + k * (a1 - a0) / {steps}) > 0 THEN exp((d1 - 1) * ln(cos(a0 + k * (a1 - a0) / {steps}))) ELSE 0 END)"
    area = f"list_sum(list_transform(range({steps} + 1), lambda k: {weight} * {height})) * (a1 - a0) / {steps} / 3"
    return let("u0", t, let("d1", df, let("a0", begin, let("a1", end, f"2 * exp(lgamma((d1 + 1) / 2) - lgamma(d1 / 2)) / sqrt({PI}) * {area}"))))


def bisected(term: str, lo: str, hi: str, steps: int = 90) -> str:
    """Root of a term in ``u`` that changes sign between two places."""
    at = lambda u: term.replace("@", u)
    half = "(b0.lo + b0.hi) / 2"
    move = f"CASE WHEN ({at('b0.lo')}) * ({at(f'({half})')}) <= 0 THEN {{'lo': b0.lo, 'hi': {half}}} ELSE {{'lo': {half}, 'hi': b0.hi}} END"
    none = "{'lo': 0::DOUBLE, 'hi': 0::DOUBLE}"
    found = f"list_reduce(list_prepend({{'lo': ({lo})::DOUBLE, 'hi': ({hi})::DOUBLE}}, list_transform(range({steps}), lambda k: {none})), lambda b0, b1: {move})"
    return f"CASE WHEN ({at(f'({lo})')}) * ({at(f'({hi})')}) <= 0 THEN list_transform([{found}], lambda b2: (b2.lo + b2.hi) / 2)[1] END"


def subsequence(a: str, b: str) -> str:
    """Length of the longest common subsequence of two lists, a row of lengths at a time."""
    rows = f"list_prepend(list_transform({b}, lambda y: 0), list_transform({a}, lambda x: list_transform({b}, lambda y: (x = y)::INT)))"
    best = "CASE WHEN hit[k] = 1 THEN coalesce(old[k - 1], 0) + 1 ELSE old[k] END"
    return f"coalesce(list_reduce({rows}, lambda old, hit: list_transform(range(1, len(old) + 1), lambda j: list_max(list_transform(range(1, j + 1), lambda k: {best}))))[-1], 0)"


EXPECTED: dict[str, Expected] = {}

# --- returns ---------------------------------------------------------------------
LOSS, GAIN = "$r < 0", "$r > 0"
BREACH = "-$r > $v"
#: No yearly rate of one return, or of a series that ends with nothing or less.
ANNUAL = "(CASE WHEN n > 1 AND grown > 0 THEN pow(grown, 252 / n) - 1 END)"


def slope(where: str = "") -> str:
    """Least squares slope of r on b over some rows."""
    mr, mb = mean("$r", where), mean("$b", where)
    return f"list_sum(list_transform([{{'mr': {mr}, 'mb': {mb}}}], lambda m: {total('($r - m.mr) * ($b - m.mb)', where)} / {total('($b - m.mb) * ($b - m.mb)', where)}))"


EXPECTED["returns"] = Expected(
    "r b v es flag x o h l c dd tail_lo walk",
    f"""
    total_return: grown - 1
    sharpe: mu / sd * sqrt(252)
    volatility: sd * sqrt(252)
    downside_deviation: down * sqrt(252)
    sortino: CASE WHEN n > 1 THEN mu / down * sqrt(252) END
    win_rate: {share(GAIN)}
    profit_factor: {total("$r", GAIN)} / -{total("$r", LOSS)}
    omega_ratio: coalesce({total("$r", GAIN)}, 0) / -{total("$r", LOSS)}
    gain_to_pain_ratio: list_sum(r) / -{total("$r", LOSS)}
    gain_loss_ratio: {mean("$r", GAIN)} / -{mean("$r", LOSS)}
    win_loss_ratio: {count(GAIN)} / {count(LOSS)}
    kelly_criterion: {count(GAIN)} / {count("$r <> 0")} - ({count(LOSS)} / {count("$r <> 0")}) / ({mean("$r", GAIN)} / -{mean("$r", LOSS)})
    upside_deviation: sqrt({mean("CASE WHEN $r > 0 THEN $r * $r ELSE 0 END")} * 252)
    upside_potential_ratio: {mean("CASE WHEN $r > 0 THEN $r ELSE 0 END")} / down
    kappa_three: mu / pow({mean("CASE WHEN $r < 0 THEN -$r * $r * $r ELSE 0 END")}, 1.0 / 3)
    downside_potential: {mean("CASE WHEN $r < 0 THEN -$r ELSE 0 END")}
    upside_potential: {mean("CASE WHEN $r > 0 THEN $r ELSE 0 END")}
    omega_sharpe_ratio: mu / {mean("CASE WHEN $r < 0 THEN -$r ELSE 0 END")}
    realized_variance: {total("$r * $r")}
    realized_volatility: sqrt({total("$r * $r")})
    tail_ratio: abs(q95) / abs(q05)
    value_at_risk: -q05
    common_sense_ratio: abs(q95) / abs(q05) * {total("$r", GAIN)} / -{total("$r", LOSS)}
    reward_to_var_ratio: CASE WHEN q05 < 0 THEN mu / -q05 END
    cvar: -worst
    starr_ratio: CASE WHEN worst < 0 THEN mu / -worst END
    rachev_ratio: {mean("$r", "$r >= q95")} / -worst
    adjusted_sharpe_ratio: mu / sd * (1 + skew / 6 * (mu / sd) - kurt / 24 * (mu / sd) * (mu / sd))
    bias_ratio: {count("$r >= 0 AND $r <= sd")} / {count("$r < 0 AND $r >= -sd")}
    max_drawdown: list_min(dd)
    calmar: {ANNUAL} / -list_min(dd)
    ulcer_index: sqrt({mean("$dd * $dd")})
    pain_index: -list_avg(dd)
    martin_ratio: {ANNUAL} / sqrt({mean("$dd * $dd")})
    recovery_factor: (grown - 1) / -list_min(dd)
    pain_ratio: {ANNUAL} / -list_avg(dd)
    sterling_ratio: {ANNUAL} / (0.1 - list_min(dd))
    burke_ratio: {ANNUAL} / sqrt({total("$dd * $dd")})
    time_underwater: {share("$dd < 0")}
    drawdown_deviation: list_stddev_samp(dd)
    drawdown_at_risk: -ddcut
    cdar: -{mean("$dd", "$dd <= ddcut")}
    max_drawdown_duration: under_longest
    max_consecutive_losses: loss_longest
    bipower_variation: {PI} / 2 * {total("abs($r) * abs(r[i - 1])", "i > 1")}
    jump_variation: CASE WHEN n > 1 THEN greatest(0, {total("$r * $r")} - {PI} / 2 * {total("abs($r) * abs(r[i - 1])", "i > 1")}) END
    variance_ratio: ({total("pow($r + r[i - 1] - 2 * mu, 2)", "i > 1")} / (2 * (n - 1) * (1 - 2 / n))) / (sd * sd)
    beta: bta
    alpha: alf * 252
    information_ratio: {mean("$r - $b")} / {spread("$r - $b")} * sqrt(252)
    tracking_error: {spread("$r - $b")} * sqrt(252)
    up_capture_ratio: {mean("$r", "$b > 0")} / {mean("$b", "$b > 0")}
    down_capture_ratio: {mean("$r", "$b < 0")} / {mean("$b", "$b < 0")}
    capture_ratio: ({mean("$r", "$b > 0")} / {mean("$b", "$b > 0")}) / ({mean("$r", "$b < 0")} / {mean("$b", "$b < 0")})
    treynor_ratio: mu * 252 / bta
    r_squared: pow(crb, 2) / ({total("pow($r - mu, 2)")} * sbb)
    active_return: {mean("$r - $b")} * 252
    m2_measure: mu / sd * list_stddev_samp(b)
    appraisal_ratio: alf / sqrt(sse / (n - 1))
    batting_average: {share("$r > $b")}
    alpha_tstat: alf / sqrt(sse / (n - 2) * (1 / n + mb * mb / sbb))
    beta_tstat: bta / sqrt(sse / (n - 2) / sbb)
    idiosyncratic_volatility: sqrt(sse / (n - 2))
    bull_beta: {slope("$b > 0")}
    bear_beta: {slope("$b < 0")}
    up_down_beta_ratio: {slope("$b > 0")} / {slope("$b < 0")}
    var_breach_rate: {share(BREACH)}
    realized_shortfall: {mean("-$r", BREACH)}
    expected_exceedance: {mean("-$r - $v", BREACH)}
    basel_traffic_light: CASE WHEN {count(BREACH)} < 5 THEN 0 WHEN {count(BREACH)} > 9 THEN 1 ELSE [0.4, 0.5, 0.65, 0.75, 0.85][{count(BREACH)}::BIGINT - 4] END
    es_backtest_ratio: -{total("$r", BREACH)} / {total("$es", BREACH)}
    acerbi_szekely_z1: {mean("-$r / $es", BREACH)} - 1
    acerbi_szekely_z2: coalesce({total("-$r / $es", BREACH)}, 0) / (n * 0.025) - 1
    parkinson_volatility: sqrt({total("pow(ln($h) - ln($l), 2)")} / (4 * n * ln(2)))
    garman_klass_volatility: sqrt({mean("pow(ln($h) - ln($l), 2) / 2 - (2 * ln(2) - 1) * pow(ln($c) - ln($o), 2)")})
    rogers_satchell_volatility: sqrt({mean("(ln($h) - ln($c)) * (ln($h) - ln($o)) + (ln($l) - ln($c)) * (ln($l) - ln($o))")})
    yang_zhang_volatility: sqrt({spread("ln($o) - ln(c[i - 1])", "i > 1", "var_samp")} + yzk * {spread("ln($c) - ln($o)", "i > 1", "var_samp")} + (1 - yzk) * {mean("(ln($h) - ln($c)) * (ln($h) - ln($o)) + (ln($l) - ln($c)) * (ln($l) - ln($o))", "i > 1")})
    hill_estimator: CASE WHEN xdown[1] > xdown[26] THEN 1 / (list_avg(list_transform(list_slice(xdown, 1, 25), lambda z: ln(z))) - ln(xdown[26])) END
    pickands_estimator: ln((xdown[25] - xdown[50]) / (xdown[50] - xdown[100])) / ln(2)
    max_to_sum_ratio: {top("$x * $x")} / {total("$x * $x")}
    rescaled_range: (greatest(0, list_max(walk)) - least(0, list_min(walk))) / list_stddev_pop(x)
    hurst_rs: hurst
    parametric_var: 1.6448536269514722 * sd - mu
    parametric_es: sd * exp(-pow(1.6448536269514722, 2) / 2) / sqrt(2 * {PI}) / 0.05 - mu
    probabilistic_sharpe_ratio: {normal("sr * sqrt(n - 1) / wide_sr")}
    deflated_sharpe: {normal(f"(sr - 0.1 * (0.42278433509846714 * 1.2815515655446004 + 0.5772156649015329 * {normal_quantile('1 - exp(-1) / 10')})) * sqrt(n - 1) / wide_sr")}
    cornish_fisher_var: cfv
    modified_sharpe_ratio: CASE WHEN cfv > 0 THEN mu / cfv END
    kupiec_pof: {chi_square_tail("-2 * (fails * ln(0.01) + (n - fails) * ln(0.99) - CASE WHEN fails > 0 THEN fails * ln(fails / n) ELSE 0 END - CASE WHEN fails < n THEN (n - fails) * ln(1 - fails / n) ELSE 0 END)", "1")}
    christoffersen_independence: CASE WHEN n > 1 THEN {chi_square_tail("markov", "1")} END
    christoffersen_cc: CASE WHEN n > 1 THEN {chi_square_tail("markov - 2 * (fails * ln(0.01) + (n - fails) * ln(0.99) - CASE WHEN fails > 0 THEN fails * ln(fails / n) ELSE 0 END - CASE WHEN fails < n THEN (n - fails) * ln(1 - fails / n) ELSE 0 END)", "2")} END
    """,
    windows=(
        "product(1 + r) OVER (PARTITION BY g ORDER BY pos) AS eq, avg(x) OVER (PARTITION BY g) AS mx, quantile_cont(r, 0.05) OVER (PARTITION BY g) AS tail_lo, row_number() OVER (PARTITION BY g ORDER BY pos) AS rn",
        "eq / greatest(1, max(eq) OVER (PARTITION BY g ORDER BY pos)) - 1 AS dd, sum(x - mx) OVER (PARTITION BY g ORDER BY pos) AS walk",
        "rn - row_number() OVER (PARTITION BY g, dd < 0 ORDER BY pos) AS under_island, rn - row_number() OVER (PARTITION BY g, r < 0 ORDER BY pos) AS loss_island",
    ),
    relations=(
        "SELECT g, max(CASE WHEN below THEN k ELSE 0 END) AS under_longest FROM (SELECT g, dd < 0 AS below, under_island, count(*) AS k FROM rows_ GROUP BY ALL) GROUP BY g",
        "SELECT g, max(CASE WHEN below THEN k ELSE 0 END) AS loss_longest FROM (SELECT g, r < 0 AS below, loss_island, count(*) AS k FROM rows_ GROUP BY ALL) GROUP BY g",
        # rescaled ranges of blocks of 8, 16, 32, ... rows, and the slope of their logarithms
        """SELECT g, regr_slope(ln(rs), ln(w)) AS hurst FROM (SELECT g, w, avg((greatest(0, hi) - least(0, lo)) / nullif(sd, 0)) AS rs FROM (
             SELECT g, w, b, max(s) AS hi, min(s) AS lo, any_value(sd) AS sd FROM (
               SELECT g, w, b, stddev_pop(x) OVER blk AS sd, sum(x) OVER (PARTITION BY g, w, b ORDER BY rn) - avg(x) OVER blk * row_number() OVER (PARTITION BY g, w, b ORDER BY rn) AS s FROM (
                 SELECT g, x, rn, w, (rn - 1) // w AS b FROM (SELECT *, count(*) OVER (PARTITION BY g) AS total FROM rows_), (SELECT 8 << j AS w FROM range(24) AS t(j)) WHERE 2 * w <= total AND rn <= total // w * w)
               WINDOW blk AS (PARTITION BY g, w, b)) GROUP BY ALL) GROUP BY ALL) WHERE rs > 0 GROUP BY g""",
    ),
    layers=(
        {
            "mu": "list_avg(r)",
            "mb": "list_avg(b)",
            "sd": "list_stddev_samp(r)",
            "grown": "list_product(list_transform(r, lambda z: 1 + z))",
            "down": f"sqrt({mean('CASE WHEN $r < 0 THEN $r * $r ELSE 0 END')})",
            "rs": "list_sort(r)",
            "ds": "list_sort(dd)",
            "xdown": "list_reverse_sort(x)",
            "yzk": "0.34 / (1.34 + n / (n - 2))",
        },
        {
            "q05": quantile("rs", 0.05),
            "q95": quantile("rs", 0.95),
            "ddcut": quantile("ds", 0.05),
            "crb": total("($r - mu) * ($b - mb)"),
            "sbb": total("pow($b - mb, 2)"),
            "m2": mean("pow($r - mu, 2)"),
            "m3": mean("pow($r - mu, 3)"),
            "m4": mean("pow($r - mu, 4)"),
        },
        {"bta": "crb / sbb", "alf": "mu - crb / sbb * mb", "worst": mean("$r", "$r <= q05"), "skew": "m3 / pow(m2, 1.5)", "kurt": "m4 / (m2 * m2) - 3"},
        {
            "sse": total("pow($r - alf - bta * $b, 2)"),
            "sr": "mu / sd",
            "wide_sr": "sqrt(1 - skew * mu / sd + (kurt + 2) / 4 * pow(mu / sd, 2))",
            "zc": "-1.6448536269514722",
            "fails": count("$flag = 1"),
            "t00": count("i > 1 AND flag[i - 1] = 0 AND $flag = 0"),
            "t01": count("i > 1 AND flag[i - 1] = 0 AND $flag = 1"),
            "t10": count("i > 1 AND flag[i - 1] = 1 AND $flag = 0"),
            "t11": count("i > 1 AND flag[i - 1] = 1 AND $flag = 1"),
        },
        {
            "cfv": "-(mu + sd * (zc + (zc * zc - 1) * skew / 6 + (pow(zc, 3) - 3 * zc) * kurt / 24 - (2 * pow(zc, 3) - 5 * zc) * skew * skew / 36))",
            # twice the log likelihood by the state before, less that of one rate
            "markov": "2 * (coalesce(t00 * ln(nullif(t00, 0) / (t00 + t01)), 0) + coalesce(t01 * ln(nullif(t01, 0) / (t00 + t01)), 0) + coalesce(t10 * ln(nullif(t10, 0) / (t10 + t11)), 0) + coalesce(t11 * ln(nullif(t11, 0) / (t10 + t11)), 0)"
            " - coalesce((t00 + t10) * ln(nullif(t00 + t10, 0) / (n - 1)), 0) - coalesce((t01 + t11) * ln(nullif(t01 + t11, 0) / (n - 1)), 0))",
        },
    ),
)

# --- classes ---------------------------------------------------------------------


def gap(name: str) -> str:
    return f"list_max({name}) - list_min({name})"


def ratio(name: str) -> str:
    return f"list_min({name}) / list_max({name})"


#: One row for each bin: rows, mean score, share of positives.
_BINS = "SELECT g, {bin} AS bin, count(*)::DOUBLE AS k, avg(q) AS conf, avg(y)::DOUBLE AS acc FROM ({rows}) GROUP BY ALL"
_EVEN = _BINS.format(bin="least(greatest(ceil(q * 15) - 1, 0), 14)", rows="SELECT * FROM rows_")
_EQUAL = _BINS.format(bin="bin", rows="SELECT *, ntile(15) OVER (PARTITION BY g ORDER BY q, pos) AS bin FROM rows_")

EXPECTED["classes"] = Expected(
    "p y s q grp",
    f"""
    accuracy: (tp + tn) / n
    precision: tp / (tp + fp)
    recall: tp / (tp + fn)
    f1: CASE WHEN tp > 0 THEN 2 * tp / (2 * tp + fp + fn) END
    specificity: tn / (tn + fp)
    fbeta: CASE WHEN tp > 0 THEN 2 * tp / (2 * tp + fp + fn) END
    jaccard: tp / (tp + fp + fn)
    g_mean: sqrt(tp / (tp + fn) * (tn / (tn + fp)))
    youden_j: tp / (tp + fn) - fp / (tn + fp)
    markedness: tp / (tp + fp) - fn / (tn + fn)
    negative_predictive_value: tn / (tn + fn)
    false_positive_rate: fp / (fp + tn)
    false_negative_rate: fn / (fn + tp)
    false_discovery_rate: fp / (fp + tp)
    positive_likelihood_ratio: tp / (tp + fn) / (fp / (fp + tn))
    negative_likelihood_ratio: fn / (fn + tp) / (tn / (tn + fp))
    diagnostic_odds_ratio: tp * tn / (fp * fn)
    threat_score: tp / (tp + fp + fn)
    fowlkes_mallows: tp / sqrt((tp + fp) * (tp + fn))
    pabak: (tp + tn - fp - fn) / n
    prevalence_threshold: (sqrt(tp / (tp + fn) * (fp / (fp + tn))) - fp / (fp + tn)) / (tp / (tp + fn) - fp / (fp + tn))
    generalized_entropy_error: (list_avg(list_transform(benefit, lambda z: z * z)) / pow(list_avg(benefit), 2) - 1) / 2
    macro_f1: list_avg([2 * tp / nullif(2 * tp + fp + fn, 0), 2 * tn / nullif(2 * tn + fp + fn, 0)])
    micro_f1: (tp + tn) / n
    weighted_f1: (coalesce((tp + fn) * 2 * tp / nullif(2 * tp + fp + fn, 0), 0) + coalesce((tn + fp) * 2 * tn / nullif(2 * tn + fp + fn, 0), 0)) / n
    mcc: CASE WHEN least(tp + fp, tp + fn, tn + fp, tn + fn) > 0 THEN (tp * tn - fp * fn) / (sqrt((tp + fp) * (tp + fn)) * sqrt((tn + fp) * (tn + fn))) ELSE 0 END
    balanced_accuracy: list_avg([tp / nullif(tp + fn, 0), tn / nullif(tn + fp, 0)])
    balanced_accuracy_adjusted: tp / (tp + fn) + tn / (tn + fp) - 1
    cohen_kappa: 2 * (tp * tn - fp * fn) / ((tp + fp) * (fp + tn) + (tp + fn) * (fn + tn))
    jaccard_macro: list_avg([tp / nullif(tp + fp + fn, 0), tn / nullif(tn + fp + fn, 0)])
    purity: (greatest(tp, fp) + greatest(tn, fn)) / n
    bcubed_precision: bp
    bcubed_recall: br
    bcubed_f1: 2 * bp * br / (bp + br)
    cohen_kappa_linear: 2 * (tp * tn - fp * fn) / ((tp + fp) * (fp + tn) + (tp + fn) * (fn + tn))
    cohen_kappa_quadratic: 2 * (tp * tn - fp * fn) / ((tp + fp) * (fp + tn) + (tp + fn) * (fn + tn))
    auc: area
    gini_norm: 2 * area - 1
    pr_auc: ap
    ks_statistic: ks
    hinge_loss: {mean("CASE WHEN $y = 1 THEN greatest(0, 1 - $s) ELSE greatest(0, 1 + $s) END")}
    squared_hinge_loss: {mean("pow(CASE WHEN $y = 1 THEN greatest(0, 1 - $s) ELSE greatest(0, 1 + $s) END, 2)")}
    exponential_loss: {mean("exp(CASE WHEN $y = 1 THEN -$s ELSE $s END)")}
    brier: bs
    log_loss: ll
    d2_log_loss_score: 1 - ll / -(base_rate * ln(base_rate) + (1 - base_rate) * ln(1 - base_rate))
    net_benefit: ({count("$q >= 0.5 AND $y = 1")} - {count("$q >= 0.5 AND $y = 0")}) / n
    brier_skill_score: 1 - bs / {mean("pow($y - base_rate, 2)")}
    calibration_in_the_large: base_rate - list_avg(q)
    spiegelhalter_z: {total("($y - $q) * (1 - 2 * $q)")} / sqrt({total("pow(1 - 2 * $q, 2) * $q * (1 - $q)")})
    sharpness: list_stddev_samp(q)
    ece: list_sum(list_transform(bins, lambda z: z.k * abs(z.acc - z.conf))) / n
    rms_calibration_error: sqrt(list_sum(list_transform(bins, lambda z: z.k * pow(z.acc - z.conf, 2))) / n)
    maximum_calibration_error: list_max(list_transform(bins, lambda z: abs(z.acc - z.conf)))
    brier_reliability: list_sum(list_transform(bins, lambda z: z.k * pow(z.acc - z.conf, 2))) / n
    brier_resolution: list_sum(list_transform(bins, lambda z: z.k * pow(z.acc - base_rate, 2))) / n
    adaptive_calibration_error: list_avg(list_transform(even, lambda z: abs(z.acc - z.conf)))
    demographic_parity_difference: {gap("rates")}
    demographic_parity_ratio: {ratio("rates")}
    equalized_odds_difference: CASE WHEN isfinite({gap("tprs")}) THEN CASE WHEN isfinite({gap("fprs")}) THEN greatest({gap("tprs")}, {gap("fprs")}) ELSE {gap("tprs")} END END
    equalized_odds_ratio: least({ratio("tprs")}, {ratio("fprs")})
    equal_opportunity_difference: {gap("tprs")}
    predictive_parity_difference: {gap("ppvs")}
    fpr_parity_difference: {gap("fprs")}
    accuracy_parity_difference: {gap("accs")}
    fdr_parity_difference: {gap("list_transform(ppvs, lambda z: 1 - z)")}
    for_parity_difference: {gap("fors")}
    average_abs_odds_difference: ({gap("tprs")} + {gap("fprs")}) / 2
    treatment_equality_difference: {gap("trade")}
    balanced_accuracy_parity_difference: {gap("bals")}
    """,
    windows=("rank() OVER (PARTITION BY g ORDER BY s) + (count(*) OVER (PARTITION BY g, s) - 1) / 2 AS mid, count(*) OVER (PARTITION BY g) AS nn, sum(y) OVER (PARTITION BY g) AS np",),
    relations=(
        # rank sum of the positives
        "SELECT g, (sum(mid) FILTER (WHERE y = 1) - any_value(np) * (any_value(np) + 1) / 2) / (any_value(np) * (any_value(nn) - any_value(np))) AS area FROM rows_ GROUP BY g",
        # each positive's precision at its own score and above
        """SELECT g, sum(hits * above) / any_value(np) AS ap FROM (SELECT g, s, np, sum(y) AS hits, sum(sum(y)) OVER down / sum(count(*)) OVER down AS above
             FROM rows_ GROUP BY g, s, np WINDOW down AS (PARTITION BY g ORDER BY s DESC)) GROUP BY g""",
        """SELECT g, max(abs(a / np - (b - a) / (nn - np))) AS ks FROM (SELECT g, np, nn, sum(y) OVER up AS a, count(*) OVER up AS b FROM rows_ WINDOW up AS (PARTITION BY g ORDER BY s)) GROUP BY g""",
        f"SELECT g, list({{'k': k, 'acc': acc, 'conf': conf}}) AS bins FROM ({_EVEN}) GROUP BY g",
        f"SELECT g, list({{'k': k, 'acc': acc, 'conf': conf}}) AS even FROM ({_EQUAL}) GROUP BY g",
        """SELECT g, list((a + b) / k) AS rates, list(a / (a + c)) AS tprs, list(b / (b + d)) AS fprs, list(a / (a + b)) AS ppvs, list((a + d) / k) AS accs, list(c / (c + d)) AS fors, list(c / b) AS trade, list((a / (a + c) + d / (b + d)) / 2) AS bals
             FROM (SELECT g, grp, sum(p * y)::DOUBLE AS a, sum(p * (1 - y))::DOUBLE AS b, sum((1 - p) * y)::DOUBLE AS c, sum((1 - p) * (1 - y))::DOUBLE AS d, count(*)::DOUBLE AS k FROM rows_ GROUP BY ALL) GROUP BY g""",
    ),
    layers=(
        {
            "tp": total("$p * $y"),
            "fp": total("$p * (1 - $y)"),
            "fn": total("(1 - $p) * $y"),
            "tn": total("(1 - $p) * (1 - $y)"),
            "benefit": each("$p - $y + 1"),
            "base_rate": "list_avg(y)",
            "bs": mean("pow($q - $y, 2)"),
            "ll": "-" + mean("ln(abs(1 - $y - $q))"),
        },
        {
            "bp": "coalesce((tp * tp + fp * fp) / nullif(tp + fp, 0) / n, 0) + coalesce((tn * tn + fn * fn) / nullif(tn + fn, 0) / n, 0)",
            "br": "coalesce((tp * tp + fn * fn) / nullif(tp + fn, 0) / n, 0) + coalesce((tn * tn + fp * fp) / nullif(tn + fp, 0) / n, 0)",
        },
    ),
)

# --- labels ----------------------------------------------------------------------
#: Pairs of rows that two clusterings put together or apart, and counts of pairs of labels.
_CELLS = "SELECT g, {a} AS a, {b} AS b, count(*)::DOUBLE AS k, sum(count(*)) OVER (PARTITION BY g, {a})::DOUBLE AS ka, sum(count(*)) OVER (PARTITION BY g, {b})::DOUBLE AS kb, sum(count(*)) OVER (PARTITION BY g)::DOUBLE AS all_ FROM rows_ GROUP BY g, {a}, {b}"


def cells(a: str, b: str) -> str:
    return _CELLS.format(a=a, b=b)


EXPECTED["labels"] = Expected(
    "ca cb ra rb",
    f"""
    mutual_info_score: mi
    normalized_mutual_info: coalesce(2 * mi / nullif(ha + hb, 0), 1)
    homogeneity_score: coalesce(mi / nullif(ha, 0), 1)
    completeness_score: coalesce(mi / nullif(hb, 0), 1)
    v_measure_score: coalesce(2 * mi / nullif(ha + hb, 0), 1)
    rand_index: (2 * both_ + n * (n - 1) / 2 - a_ - b_) / (n * (n - 1) / 2)
    adjusted_rand_index: coalesce((both_ - a_ * b_ / (n * (n - 1) / 2)) / nullif((a_ + b_) / 2 - a_ * b_ / (n * (n - 1) / 2), 0), 1)
    fowlkes_mallows_clustering: both_ / sqrt(a_ * b_)
    percentage_agreement: po
    scott_pi: (po - pooled) / (1 - pooled)
    brennan_prediger: (po - 1 / kinds) / (1 - 1 / kinds)
    gwet_ac1: (po - (1 - pooled) / (kinds - 1)) / (1 - (1 - pooled) / (kinds - 1))
    """,
    relations=(
        f"SELECT g, sum(k / all_ * ln(k * all_ / (ka * kb))) AS mi, sum(k * (k - 1) / 2) AS both_ FROM ({cells('ca', 'cb')}) GROUP BY g",
        "SELECT g, -sum(k / t * ln(k / t)) AS ha, sum(k * (k - 1) / 2) AS a_ FROM (SELECT g, ca, count(*)::DOUBLE AS k, sum(count(*)) OVER (PARTITION BY g)::DOUBLE AS t FROM rows_ GROUP BY g, ca) GROUP BY g",
        "SELECT g, -sum(k / t * ln(k / t)) AS hb, sum(k * (k - 1) / 2) AS b_ FROM (SELECT g, cb, count(*)::DOUBLE AS k, sum(count(*)) OVER (PARTITION BY g)::DOUBLE AS t FROM rows_ GROUP BY g, cb) GROUP BY g",
        "SELECT g, count(*)::DOUBLE AS kinds, sum(pow(k / t, 2)) AS pooled FROM (SELECT g, x, count(*)::DOUBLE AS k, sum(count(*)) OVER (PARTITION BY g)::DOUBLE AS t FROM (SELECT g, unnest([ra, rb]) AS x FROM rows_) GROUP BY g, x) GROUP BY g",
    ),
    layers=({"po": share("$ra = $rb")},),
)

# --- fits ------------------------------------------------------------------------
E_ = "($p - $a)"
TWEEDIE = "pow(greatest($a, 0), 0.5) / -0.25 + $a * pow({0}, -0.5) / 0.5 + pow({0}, 0.5) / 0.5"
EXPECTED["fits"] = Expected(
    "p a e x y lo hi",
    f"""
    rmse: sqrt(mse)
    mae: ae
    mean_squared_error: mse
    msle: {mean("pow(ln(1 + $p) - ln(1 + $a), 2)")}
    rmsle: sqrt({mean("pow(ln(1 + $p) - ln(1 + $a), 2)")})
    medae: list_median({each("abs($p - $a)")})
    max_error: {top("abs($p - $a)")}
    explained_variance: 1 - {spread("$a - $p", how="var_pop")} / (saa / n)
    nrmse: sqrt(mse) / ma
    concordance_correlation: 2 * spa / (spp + saa + n * pow(mp - ma, 2))
    huber_loss: {mean("CASE WHEN abs($p - $a) <= 1 THEN pow($p - $a, 2) / 2 ELSE abs($p - $a) - 0.5 END")}
    poisson_deviance: 2 * {mean("CASE WHEN $a > 0 THEN $a * (ln($a) - ln($p)) ELSE 0 END - $a + $p")}
    gamma_deviance: 2 * {mean("ln($p) - ln($a) + $a / $p - 1")}
    r2: 1 - mse * n / saa
    adjusted_r2: 1 - mse * n / saa * (n - 1) / (n - 2)
    mean_tweedie_deviance: 2 * {mean(TWEEDIE.format("$p"))}
    d2_absolute_error: 1 - ae / {mean("abs($a - med)")}
    d2_pinball_score: 1 - ae / {mean("abs($a - med)")}
    d2_tweedie_score: 1 - {mean(TWEEDIE.format("$p"))} / {mean(TWEEDIE.format("ma"))}
    durbin_watson: {total("pow(($a - $p) - (a[i - 1] - p[i - 1]), 2)", "i > 1")} / (n * mse)
    log_likelihood_gaussian: ll
    aic: 2 - 2 * ll
    bic: ln(n) - 2 * ll
    aicc: CASE WHEN n > 2 THEN 2 - 2 * ll + 4 / (n - 2) END
    hqic: 2 * ln(ln(n)) - 2 * ll
    breusch_pagan_lm: n * fit2
    breusch_pagan_fstat: fit2 / (1 - fit2) * (n - 2)
    white_lm: n * white
    goldfeld_quandt_fstat: gq_hi / gq_lo
    ols_slope: sxy / sxx
    ols_intercept: my - sxy / sxx * mx
    residual_standard_error: sqrt(sse / (n - 2))
    regression_f_statistic: (syy - sse) / (sse / (n - 2))
    regression_t_statistic: sxy / sxx / sqrt(sse / (n - 2) / sxx)
    mape: {mean("abs(($p - $a) / $a)")}
    pinball_loss: ae / 2
    wape: ae / {mean("abs($a)")}
    forecast_bias: mp / ma - 1
    theil_u1: sqrt(mse) / (sqrt({mean("$p * $p")}) + sqrt({mean("$a * $a")}))
    tracking_signal: {total("$p - $a")} / ae
    mean_percentage_error: {mean("1 - $p / $a")}
    median_absolute_percentage_error: list_median({each("abs(1 - $p / $a)")})
    mean_arctangent_ape: {mean("atan(abs(1 - $p / $a))", "$a <> 0")}
    geometric_mean_absolute_error: CASE WHEN {count("$p = $a")} > 0 THEN 0 ELSE exp({mean("ln(abs($p - $a))")}) END
    cumulative_forecast_error: {total("$a - $p")}
    kling_gupta_efficiency: 1 - sqrt(pow(spa / sqrt(spp * saa) - 1, 2) + pow(sqrt(spp / saa) - 1, 2) + pow(mp / ma - 1, 2))
    root_mean_square_percentage_error: sqrt({mean("pow(1 - $p / $a, 2)")})
    fractional_bias: 2 * (ma - mp) / (ma + mp)
    mean_bias_error: {mean("$p - $a")}
    log_nash_sutcliffe: 1 - {total("pow(ln($a / $p), 2)")} / (n * {spread("ln($a)", how="var_pop")})
    relative_absolute_error: ae / {mean("abs($a - ma)")}
    relative_squared_error: mse * n / saa
    nash_sutcliffe_efficiency: 1 - mse * n / saa
    willmott_index: 1 - mse * n / {total("pow(abs($p - ma) + abs($a - ma), 2)")}
    legates_mccabe_efficiency: 1 - ae / {mean("abs($a - ma)")}
    refined_willmott_index: CASE WHEN ae <= 2 * {mean("abs($a - ma)")} THEN 1 - ae / (2 * {mean("abs($a - ma)")}) ELSE 2 * {mean("abs($a - ma)")} / ae - 1 END
    theil_u2: sqrt({total("pow(($p - $a) / a[i - 1], 2)", "i > 1")} / {total("pow(($a - a[i - 1]) / a[i - 1], 2)", "i > 1")})
    rmsse: sqrt(mse / {mean("pow($a - a[i - 1], 2)", "i > 1")})
    mean_directional_accuracy: {mean("(sign($a - a[i - 1]) = sign($p - a[i - 1]))::INT", "i > 1")}
    mase: ae / {mean("abs($a - a[i - 1])", "i > 1")}
    mean_interval_width: list_avg(hi) - list_avg(lo)
    interval_coverage: {share("$a >= $lo AND $a <= $hi")}
    winkler_score: {mean("$hi - $lo + 20 * greatest(0, $lo - $a) + 20 * greatest(0, $a - $hi)")}
    coverage_deviation: {share("$a >= $lo AND $a <= $hi")} - 0.9
    """,
    windows=("row_number() OVER (PARTITION BY g ORDER BY x, pos) AS rx, count(*) OVER (PARTITION BY g) AS nn",),
    relations=(
        # residual sums of squares of lines through the upper and the lower half by x
        "SELECT g, sum(pow(e - f, 2)) FILTER (WHERE up) AS gq_hi, sum(pow(e - f, 2)) FILTER (WHERE dn) AS gq_lo FROM (SELECT *, rx > nn - nn // 2 AS up, rx <= nn // 2 AS dn, regr_intercept(e, x) OVER half + regr_slope(e, x) OVER half * x AS f FROM rows_ WINDOW half AS (PARTITION BY g, rx > nn - nn // 2, rx <= nn // 2)) GROUP BY g",
    ),
    layers=(
        {"mp": "list_avg(p)", "ma": "list_avg(a)", "mx": "list_avg(x)", "my": "list_avg(y)", "med": "list_median(a)", "mse": mean("pow($p - $a, 2)"), "ae": mean("abs($p - $a)"), "me2": mean("$e * $e"), "sx": "list_stddev_pop(x)"},
        {
            "spa": total("($p - mp) * ($a - ma)"),
            "spp": total("pow($p - mp, 2)"),
            "saa": total("pow($a - ma, 2)"),
            "sxx": total("pow($x - mx, 2)"),
            "sxy": total("($x - mx) * ($y - my)"),
            "syy": total("pow($y - my, 2)"),
            "ll": f"-n / 2 * (ln(2 * {PI} * me2) + 1)",
            "see": total("pow($e * $e - me2, 2)"),
            "sex": total("($e * $e - me2) * ($x - mx)"),
            # the square of a standardised x, less its mean and its part along x
            "skx": mean("pow(($x - mx) / sx, 3)"),
        },
        {"sse": total("pow($y - my - sxy / sxx * ($x - mx), 2)"), "fit2": "sex * sex / (see * sxx)", "zz": each("pow(($x - mx) / sx, 2) - 1 - skx * ($x - mx) / sx")},
        {"white": f"(sex * sex / sxx + pow({total('($e * $e - me2) * $zz')}, 2) / {total('$zz * $zz')}) / see"},
    ),
)

# --- columns ---------------------------------------------------------------------
def diverse(q: int) -> str:
    return total(f"pow($x / sx, {q})", "$x > 0")


MIX = "$x <> 0 AND $y = 0 OR $x = 0 AND $y <> 0"
ENDS = "floor(0.1 * n)::BIGINT"
SORTED_SHARE = "list_sum(list_transform(places, lambda i: {}))"

EXPECTED["columns"] = Expected(
    "x y w dp dq flag s lk jk d side v hits original compressed uptime downtime failures operating_time repairs defects size opportunities passed total yield_step",
    f"""
    column_sum: list_sum(x)
    column_mean: mu
    column_median: med
    percentile: med
    column_min: xs[1]
    column_max: list_max(x)
    column_std: sqrt(ss / (n - 1))
    iqr: q3 - q1
    hhi: list_sum(list_transform(x, lambda z: pow(z / sx, 2)))
    variance: ss / (n - 1)
    range_value: list_max(x) - list_min(x)
    geometric_mean: exp(mlog)
    harmonic_mean: 1 / list_avg(list_transform(x, lambda z: 1 / z))
    atkinson_index: 1 - exp(mlog) / mu
    quartile_coefficient_dispersion: (q3 - q1) / (q3 + q1)
    index_of_dispersion: ss / (n - 1) / mu
    percentile_ratio: {quantile("xs", 0.9)} / {quantile("xs", 0.1)}
    mean_log_deviation: ln(mu) - mlog
    pearson_median_skewness: 3 * (mu - med) / sqrt(ss / (n - 1))
    studentized_range: (list_max(x) - list_min(x)) / sqrt(ss / (n - 1))
    midhinge: (q1 + q3) / 2
    trimean: (q1 + 2 * med + q3) / 4
    gastwirth_location: 0.3 * {quantile("xs", "1.0 / 3")} + 0.4 * med + 0.3 * {quantile("xs", "2.0 / 3")}
    power_mean: sqrt(list_avg(list_transform(x, lambda z: z * z)))
    lehmer_mean: list_sum(list_transform(x, lambda z: z * z)) / sx
    geometric_std: exp({spread("ln($x)")})
    root_mean_square: sqrt(list_avg(list_transform(x, lambda z: z * z)))
    margalef_richness: (n - 1) / ln(sx)
    menhinick_richness: n / sqrt(sx)
    mcintosh_diversity: (sx - sqrt(list_sum(list_transform(x, lambda z: z * z)))) / (sx - sqrt(sx))
    row_count: n
    mean_abs_deviation: mad
    theil_index: {mean("$x / mu * ln($x / mu)")}
    hoover_index: mad / mu / 2
    generalized_entropy_index: ss / n / (mu * mu) / 2
    relative_mean_deviation: mad / mu
    median_abs_deviation: list_median({each("abs($x - med)")})
    outlier_count: {count("$x < q1 - 1.5 * (q3 - q1) OR $x > q3 + 1.5 * (q3 - q1)")}
    shannon_diversity: ent
    pielou_evenness: ent / ln({count("$x > 0")})
    berger_parker: list_max(x) / sx
    normalized_hhi: ({diverse(2)} - 1 / n) / (1 - 1 / n)
    hill_number: exp(ent)
    renyi_entropy: -ln({diverse(2)})
    tsallis_entropy: 1 - {diverse(2)}
    simpson_evenness: 1 / {diverse(2)} / {count("$x > 0")}
    concentration_ratio: list_sum(xs[-4:]) / sx
    rosenbluth_index: 1 / (2 * {SORTED_SHARE.format("(n + 1 - i) * xs[i] / sx")} - 1)
    comprehensive_concentration_index: list_max(x) / sx + list_sum(list_transform(range(1, n::BIGINT), lambda i: pow(xs[i] / sx, 2) * (2 - xs[i] / sx)))
    gini_coefficient: gini
    sen_welfare: mu * (1 - gini)
    gini_mean_difference: gini * 2 * mu * n / (n - 1)
    relative_mean_difference: gini * 2 * n / (n - 1)
    l_scale: gini * mu * n / (n - 1)
    l_cv: gini * n / (n - 1)
    trimmed_mean: list_avg(list_slice(xs, {ENDS} + 1, n::BIGINT - {ENDS}))
    trimmed_std: list_stddev_samp(list_slice(xs, {ENDS} + 1, n::BIGINT - {ENDS}))
    winsorized_mean: list_avg(list_transform(x, lambda z: least(greatest(z, xs[{ENDS} + 1]), xs[n::BIGINT - {ENDS}])))
    winsorized_std: list_stddev_samp(list_transform(x, lambda z: least(greatest(z, xs[{ENDS} + 1]), xs[n::BIGINT - {ENDS}])))
    hodges_lehmann_estimator: walsh
    distinct_count: len(list_distinct(s))
    null_fraction: 0
    duplicate_count: n - len(list_distinct(s))
    uniqueness_ratio: len(list_distinct(s)) / n
    mode_share: list_max(map_values(list_histogram(s))) / n
    entropy: list_entropy(s)
    groupby_aggregate: {mean("$x", "$s = 'AF'")}
    join_row_loss: {count("$jk IS NULL")}
    ratio_share: {share("$flag <> 0")}
    weighted_mean: {total("$w * $x")} / list_sum(w)
    psi: {total("($dq / sq - $dp / sp) * (ln($dq) - ln(sq) - ln($dp) + ln(sp))")}
    growth_rate: x[-1] / x[-2] - 1
    covariance: {total("($x - mu) * ($y - my)")} / (n - 1)
    euclidean_distance: sqrt({total("pow($x - $y, 2)")})
    squared_euclidean_distance: {total("pow($x - $y, 2)")}
    manhattan_distance: {total("abs($x - $y)")}
    chebyshev_distance: {top("abs($x - $y)")}
    cosine_distance: 1 - {total("$x * $y")} / sqrt({total("$x * $x")} * {total("$y * $y")})
    braycurtis_distance: {total("abs($x - $y)")} / {total("abs($x + $y)")}
    canberra_distance: {total("abs($x - $y) / (abs($x) + abs($y))", "$x <> 0 OR $y <> 0")}
    correlation_distance: 1 - {total("($x - mu) * ($y - my)")} / sqrt(ss * {total("pow($y - my, 2)")})
    minkowski_distance: sqrt({total("pow($x - $y, 2)")})
    hamming_distance: {share("$x <> $y")}
    dice_distance: {count(MIX)} / (2 * {count("$x <> 0 AND $y <> 0")} + {count(MIX)})
    rogers_tanimoto_distance: 2 * {count(MIX)} / (n + {count(MIX)})
    russell_rao_distance: 1 - {share("$x <> 0 AND $y <> 0")}
    sokal_sneath_distance: 2 * {count(MIX)} / ({count("$x <> 0 AND $y <> 0")} + 2 * {count(MIX)})
    yule_distance: CASE WHEN {count("$x <> 0 AND $y = 0")} * {count("$x = 0 AND $y <> 0")} > 0 THEN 2 / (1 + {count("$x <> 0 AND $y <> 0")} * {count("$x = 0 AND $y = 0")} / ({count("$x <> 0 AND $y = 0")} * {count("$x = 0 AND $y <> 0")})) ELSE 0 END
    latency_p50: {quantile("ds", 0.5)}
    latency_p75: {quantile("ds", 0.75)}
    latency_p90: {quantile("ds", 0.9)}
    latency_p95: {quantile("ds", 0.95)}
    latency_p99: {quantile("ds", 0.99)}
    latency_p999: {quantile("ds", 0.999)}
    tail_latency_ratio: {quantile("ds", 0.99)} / {quantile("ds", 0.5)}
    latency_stddev: sqrt({total("pow($d - md, 2)")} / (n - 1))
    throughput: 1 / md
    apdex: ({count("$d <= 1")} + {count("$d > 1 AND $d <= 4")} / 2) / n
    slo_attainment: {share("$d <= 0")}
    jitter: {mean("abs($d - d[i - 1])", "i > 1")}
    peak_memory: list_max(x)
    test_coverage: {share("$hits > 0")}
    error_rate: {share("$flag <> 0")}
    uptime_pct: {share("$flag <> 0")}
    cache_hit_rate: {share("$flag <> 0")}
    error_budget_burn: {share("$flag <> 0")} * 100
    mtbf: n / {count("$flag <> 0")}
    compression_ratio: list_avg(original) / list_avg(compressed)
    availability: 1 - list_sum(downtime) / (list_sum(uptime) + list_sum(downtime))
    failure_rate: list_avg(failures) / list_avg(operating_time)
    mean_time_to_repair: list_avg(downtime) / list_avg(repairs)
    mean_time_to_failure: list_avg(uptime) / list_avg(failures)
    defect_density: list_avg(defects) / list_avg(size)
    dpmo: 1000000 * list_avg(defects) / list_avg(opportunities)
    first_pass_yield: list_avg(passed) / list_avg(total)
    rolled_throughput_yield: list_product(yield_step)
    speedup_ratio: {mean("$v", "$side = 'a'")} / {mean("$v", "$side = 'b'")}
    """,
    relations=(
        # median of the means of all pairs i <= j, equal values counted together
        """SELECT g, median(v) AS walsh FROM (SELECT a.g, unnest(list_resize([]::DOUBLE[], CASE WHEN a.x = b.x THEN a.k * (a.k + 1) // 2 ELSE a.k * b.k END, (a.x + b.x) / 2)) AS v
             FROM (SELECT g, x, count(*) AS k FROM rows_ GROUP BY ALL) a JOIN (SELECT g, x, count(*) AS k FROM rows_ GROUP BY ALL) b ON a.g = b.g AND a.x <= b.x) GROUP BY g""",
    ),
    layers=(
        {"mu": "list_avg(x)", "my": "list_avg(y)", "md": "list_avg(d)", "sx": "list_sum(x)", "sp": "list_sum(dp)", "sq": "list_sum(dq)", "xs": "list_sort(x)", "ds": "list_sort(d)", "mlog": mean("ln($x)")},
        {
            "q1": quantile("xs", 0.25),
            "med": quantile("xs", 0.5),
            "q3": quantile("xs", 0.75),
            "ss": total("pow($x - mu, 2)"),
            "mad": mean("abs($x - mu)"),
            "ent": "-" + total("$x / sx * ln($x / sx)", "$x > 0"),
            # mean difference of all pairs over twice the mean
            "gini": "list_sum(list_transform(places, lambda i: xs[i] * (2 * i - n - 1))) / (n * n * mu)",
        },
    ),
)

# --- pairs -----------------------------------------------------------------------
_LAG = "list_sum(list_transform(places[{k} + 1:], lambda i: (x[i] - mx) * (x[i - {k}] - mx))) / sxx"
EXPECTED["pairs"] = Expected(
    "x y d ev sc rx ry",
    f"""
    skewness: sk
    kurtosis: ku
    skewtest: CASE WHEN n >= 8 THEN zs END
    kurtosistest: CASE WHEN n >= 5 THEN zk END
    normaltest: CASE WHEN n >= 8 THEN zs * zs + zk * zk END
    kstat_third: n * n * m3 / ((n - 1) * (n - 2))
    kstat_fourth: n * n * ((n + 1) * m4 - 3 * (n - 1) * m2 * m2) / ((n - 1) * (n - 2) * (n - 3))
    bowley_skewness: (q3 + q1 - 2 * q2) / (q3 - q1)
    moors_kurtosis: CASE WHEN n >= 8 THEN ({quantile("xs", 0.875)} - {quantile("xs", 0.625)} + {quantile("xs", 0.375)} - {quantile("xs", 0.125)}) / (q3 - q1) END
    l_skewness: CASE WHEN n >= 4 AND list_max(x) > list_min(x) THEN l3 / l2 END
    l_kurtosis: CASE WHEN n >= 4 AND list_max(x) > list_min(x) THEN l4 / l2 END
    differential_entropy: {mean("ln(n / (2 * half) * (xs[least(i + half, n)::BIGINT] - xs[greatest(i - half, 1)::BIGINT]))")}
    correlation: sxy / sqrt(sxx * syy)
    linregress_slope_stderr: se
    linregress_intercept_stderr: se * sqrt({mean("$x * $x")})
    blomqvist_beta: ({count("($x - q2) * ($y - ymed) > 0")} - {count("($x - q2) * ($y - ymed) < 0")}) / {count("($x - q2) * ($y - ymed) <> 0")}
    chatterjee_xi: xi
    kendall_tau: (con - dis) / sqrt((pairs - tx) * (pairs - ty))
    theil_sen_slope: slope_all
    somers_d: (con - dis) / (pairs - tx)
    goodman_kruskal_gamma: (con - dis) / (con + dis)
    siegel_slope: slope_each
    distance_correlation: dcor
    concordance_index: ci
    km_median_survival: km50
    km_survival_at: km30
    nelson_aalen_cumhaz: na30
    restricted_mean_survival_time: rmst
    autocorrelation: {_LAG.format(k=1)}
    box_pierce: n * list_sum(list_transform(range(1, 11), lambda k: pow({_LAG.format(k="k")}, 2)))
    zero_crossing_rate: {mean("(($x < 0) <> (x[i - 1] < 0))::INT", "i > 1")}
    hjorth_mobility: sqrt(vd / m2)
    hjorth_complexity: sqrt(vdd / vd) / sqrt(vd / m2)
    turning_point_rate: CASE WHEN n > 2 THEN {count("i > 1 AND i < n AND ($x - x[i - 1]) * (x[i + 1] - $x) < 0")} / (n - 2) END
    rms_successive_differences: sqrt({mean("pow($x - x[i - 1], 2)", "i > 1")})
    mean_absolute_change: {mean("abs($x - x[i - 1])", "i > 1")}
    arch_lm: (n - 1) * arch
    runs_test: CASE WHEN n >= 50 THEN runs - expected_runs WHEN runs - expected_runs > 0.5 THEN runs - expected_runs - 0.5 WHEN runs - expected_runs < 0.5 THEN runs - expected_runs + 0.5 ELSE 0 END / sqrt((expected_runs - 1) * (expected_runs - 2) / (n - 1))
    permutation_entropy: perm
    jarque_bera: exp(-n / 12 * (sk * sk + ku * ku / 4))
    confidence_interval: tq * sqrt(sxx / (n - 1) / n)
    anderson_darling: -n - {total("(2 * i - 1) * ln(low_[i]) + (2 * (n - i) + 1) * ln(high_[i])")} / n
    gaussian_rank_correlation: {total("$nx * $ny")} / {total("pow($ni, 2)")}
    ljung_box: {chi_square_tail(f"n * (n + 2) * list_sum(list_transform(range(1, least(11, n)::BIGINT), lambda k: pow({_LAG.format(k='k')}, 2) / (n - k)))", "least(10, n - 1)")}
    partial_autocorrelation: {_LAG.format(k=1)}
    """,
    windows=("count(*) OVER (PARTITION BY g ORDER BY y) AS upto_y, count(*) OVER (PARTITION BY g ORDER BY y DESC) AS from_y, count(*) OVER (PARTITION BY g) AS nn, row_number() OVER (PARTITION BY g ORDER BY x, pos) AS along, " + rank_of("x") + " AS rx, " + rank_of("y") + " AS ry",),
    relations=(
        "SELECT g, 1 - any_value(nn) * sum(abs(step)) / (2.0 * sum(from_y * (nn - from_y))) AS xi FROM (SELECT *, upto_y - lag(upto_y) OVER (PARTITION BY g ORDER BY along) AS step FROM rows_) GROUP BY g",
        "SELECT g, count(*)::DOUBLE AS pairs, count(*) FILTER (a > 0 AND b > 0 OR a < 0 AND b < 0)::DOUBLE AS con, count(*) FILTER (a > 0 AND b < 0 OR a < 0 AND b > 0)::DOUBLE AS dis, count(*) FILTER (a = 0)::DOUBLE AS tx, count(*) FILTER (b = 0)::DOUBLE AS ty, median(b / a) FILTER (a <> 0) AS slope_all "
        "FROM (SELECT u.g, v.x - u.x AS a, v.y - u.y AS b FROM rows_ u JOIN rows_ v ON u.g = v.g AND u.along < v.along) GROUP BY g",
        "SELECT g, median(m) AS slope_each FROM (SELECT u.g, u.along, median((v.y - u.y) / (v.x - u.x)) FILTER (v.x <> u.x) AS m FROM rows_ u JOIN rows_ v ON u.g = v.g GROUP BY ALL) GROUP BY g",
        # distances, doubly centred by windows over rows and columns
        """SELECT g, sqrt(avg(a * b)) / sqrt(sqrt(avg(a * a)) * sqrt(avg(b * b))) AS dcor FROM (
             SELECT g, a - avg(a) OVER (PARTITION BY g, i) - avg(a) OVER (PARTITION BY g, j) + avg(a) OVER (PARTITION BY g) AS a, b - avg(b) OVER (PARTITION BY g, i) - avg(b) OVER (PARTITION BY g, j) + avg(b) OVER (PARTITION BY g) AS b
             FROM (SELECT u.g, u.along AS i, v.along AS j, abs(u.x - v.x) AS a, abs(u.y - v.y) AS b FROM rows_ u JOIN rows_ v ON u.g = v.g)) GROUP BY g""",
        "SELECT u.g, avg(CASE WHEN u.sc < v.sc THEN 1 WHEN u.sc = v.sc THEN 0.5 ELSE 0 END) AS ci FROM rows_ u JOIN rows_ v ON u.g = v.g AND u.ev = 1 AND u.d < v.d GROUP BY u.g",
        # survival: the product of (1 - deaths / at risk) over times
        """SELECT g, min(d) FILTER (s <= 0.5 + 1e-12) AS km50, coalesce(min(s) FILTER (d <= 30), 1) AS km30, coalesce(sum(h) FILTER (d <= 30), 0) AS na30,
             least(min(d), 60) + coalesce(sum(s * (least(coalesce(later, 60), 60) - d)) FILTER (d < 60), 0) AS rmst FROM (
               SELECT g, d, h, product(1 - h) OVER t AS s, lead(d) OVER t AS later FROM (
                 SELECT g, d, sum(ev)::DOUBLE / sum(count(*)) OVER (PARTITION BY g ORDER BY d DESC) AS h FROM rows_ GROUP BY g, d) WHERE h > 0 WINDOW t AS (PARTITION BY g ORDER BY d)) GROUP BY g""",
        "SELECT g, entropy(shape) * ln(2) / ln(6) AS perm FROM (SELECT g, (x > x1)::INT || (x > x2)::INT || (x1 > x2)::INT AS shape FROM (SELECT g, x, lead(x) OVER t AS x1, lead(x, 2) OVER t AS x2 FROM rows_ WINDOW t AS (PARTITION BY g ORDER BY pos)) WHERE x2 IS NOT NULL) GROUP BY g",
        "SELECT g, regr_r2(now, before) AS arch FROM (SELECT g, x * x AS now, lag(x * x) OVER (PARTITION BY g ORDER BY pos) AS before FROM rows_) GROUP BY g",
    ),
    layers=(
        {"mx": "list_avg(x)", "my": "list_avg(y)", "xs": "list_sort(x)", "ymed": "list_median(y)", "half": "floor(sqrt(n) + 0.5)", "ups": count("$x >= 0")},
        {
            "m2": mean("pow($x - mx, 2)"),
            "m3": mean("pow($x - mx, 3)"),
            "m4": mean("pow($x - mx, 4)"),
            "sxx": total("pow($x - mx, 2)"),
            "syy": total("pow($y - my, 2)"),
            "sxy": total("($x - mx) * ($y - my)"),
            "q1": quantile("xs", 0.25),
            "q2": quantile("xs", 0.5),
            "q3": quantile("xs", 0.75),
            "vd": spread("$x - x[i - 1]", "i > 1", "var_pop"),
            "vdd": spread("$x - 2 * x[i - 1] + x[i - 2]", "i > 2", "var_pop"),
            "l2": total("xs[i] * (2 * (i - 1) / (n - 1) - 1)") + " / n",
            "l3": total("xs[i] * (6 * (i - 1) * (i - 2) / ((n - 1) * (n - 2)) - 6 * (i - 1) / (n - 1) + 1)") + " / n",
            "l4": total("xs[i] * (20 * (i - 1) * (i - 2) * (i - 3) / ((n - 1) * (n - 2) * (n - 3)) - 30 * (i - 1) * (i - 2) / ((n - 1) * (n - 2)) + 12 * (i - 1) / (n - 1) - 1)") + " / n",
            "runs": "1 + " + count("i > 1 AND ($x >= 0) <> (x[i - 1] >= 0)"),
            "expected_runs": "1 + 2 * ups * (n - ups) / n",
        },
        {
            "sk": "m3 / pow(m2, 1.5)",
            "ku": "m4 / (m2 * m2) - 3",
            "se": "sqrt((syy - sxy * sxy / sxx) / (n - 2) / sxx)",
            "beta2": "3 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9))",
            "vb2": "24 * n * (n - 2) * (n - 3) / ((n + 1) * (n + 1) * (n + 3) * (n + 5))",
            "sb1": "6 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * sqrt(6 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3)))",
        },
        {"ww": "sqrt(2 * beta2 - 2) - 1", "aa": "6 + 8 / sb1 * (2 / sb1 + sqrt(1 + 4 / (sb1 * sb1)))", "xk": "(m4 / (m2 * m2) - 3 * (n - 1) / (n + 1)) / sqrt(vb2)"},
        {"zs": "asinh(sk * sqrt((n + 1) * (n + 3) / (6 * (n - 2))) / sqrt(2 / (ww - 1))) / sqrt(ln(ww) / 2)", "den": "1 + xk * sqrt(2 / (aa - 4))"},
        {
            "low_": each(normal("(xs[i] - mx) / sqrt(sxx / (n - 1))")),
            "high_": each(normal("(mx - xs[i]) / sqrt(sxx / (n - 1))")),
            "nx": each(normal_quantile("$rx / (n + 1)")),
            "ny": each(normal_quantile("$ry / (n + 1)")),
            "ni": each(normal_quantile("i / (n + 1)")),
            # the two-sided tail of Student's distribution is 0.05 there
            "tq": bisected(f"{student_tail('@', 'n - 1')} - 0.05", "1.9", "60", 50),
        },
        {"zk": "(1 - 2 / (9 * aa) - sign(den) * pow((1 - 2 / aa) / abs(den), 1.0 / 3)) / sqrt(2 / (9 * aa))"},
    ),
)

# --- squares ---------------------------------------------------------------------
EXPECTED["squares"] = Expected(
    "grp outcome",
    f"""
    cramers_v: sqrt(chi / n)
    tschuprow_t: sqrt(chi / n)
    pearson_contingency_coefficient: sqrt(chi / (chi + n))
    cohens_w: sqrt(chi / n)
    odds_ratio: c11 * c22 / (c12 * c21)
    relative_risk: (c11 / (c11 + c12)) / (c21 / (c21 + c22))
    chi_square_statistic: n * pow(abs(c11 * c22 - c12 * c21) - n / 2, 2) / ((c11 + c12) * (c21 + c22) * (c11 + c21) * (c12 + c22))
    g_test_statistic: 2 * gt
    g_test: {chi_square_tail("2 * gt", "1")}
    chi_square: {chi_square_tail("n * CASE WHEN c11 * c22 = c12 * c21 THEN 0 ELSE pow(abs(c11 * c22 - c12 * c21) - n / 2, 2) END / ((c11 + c12) * (c21 + c22) * (c11 + c21) * (c12 + c22))", "1")}
    fisher_exact: list_sum(list_filter(chances, lambda w: w <= seen * 1.0000001)) / list_sum(chances)
    srm_pvalue: {chi_square_tail("pow(c11 + c12 - n / 2, 2) / (n / 4)", "1")}
    """,
    relations=(f"SELECT g, sum(k * ln(k * all_ / (ka * kb))) AS gt FROM ({cells('grp', 'outcome')}) GROUP BY g",),
    layers=(
        {"g1": "list_min(grp)", "o1": "list_min(outcome)"},
        {"c11": count("$grp = g1 AND $outcome = o1"), "c12": count("$grp = g1 AND $outcome <> o1"), "c21": count("$grp <> g1 AND $outcome = o1"), "c22": count("$grp <> g1 AND $outcome <> o1")},
        {
            "chi": "n * pow(c11 * c22 - c12 * c21, 2) / ((c11 + c12) * (c21 + c22) * (c11 + c21) * (c12 + c22))",
            # chances of the tables with these margins, over that of the table seen
            "chances": "list_transform(range(greatest(0, c11 - c22)::BIGINT, least(c11 + c12, c11 + c21)::BIGINT + 1), lambda x: exp(lgamma(c11 + 1) + lgamma(c12 + 1) + lgamma(c21 + 1) + lgamma(c22 + 1) - lgamma(x + 1) - lgamma(c11 + c12 - x + 1) - lgamma(c11 + c21 - x + 1) - lgamma(c22 - c11 + x + 1)))",
            "seen": "1",
        },
    ),
)

# --- samples ---------------------------------------------------------------------
_TWO_SIDES = lambda z: let("side", z, f"CASE WHEN side >= 0 THEN 2 * {upper_tail('abs(side)')} ELSE 2 - 2 * {upper_tail('abs(side)')} END")
#: Groups of grp: distances from the group's median, and their ranks over the key.
_AWAY = "SELECT *, count(*) OVER (PARTITION BY g) AS nn, rank() OVER (PARTITION BY g ORDER BY away) + (count(*) OVER (PARTITION BY g, away) - 1) / 2 AS place FROM (SELECT g, grp, abs(v - median(v) OVER (PARTITION BY g, grp)) AS away FROM rows_)"
#: Rows of eras with ranks of predictions, of the meta model, and the target about its mean.
_ERAS = f"SELECT *, count(*) OVER e AS size, target - avg(target) OVER e AS yc, min(target) OVER e AS lo, max(target) OVER e AS hi, {rank_of('p', 'g, era')} AS rp, {rank_of('meta', 'g, era')} AS rm FROM rows_ WINDOW e AS (PARTITION BY g, era)"


def _bent(x: str) -> str:
    return f"sign({x}) * pow(abs({x}), 1.5)"


_NORMAL_SCORE = normal_quantile("least(greatest((rp - 0.5) / size, 1e-6), 1 - 1e-6)")
#: What is left of normal scores after a least squares fit on two centred features.
_CENTRED = f"SELECT g, era, size, yc, z - avg(z) OVER e AS z, f1 - avg(f1) OVER e AS a, f2 - avg(f2) OVER e AS b FROM (SELECT *, {normal_quantile('least(greatest((rp - 0.5) / size, 1e-12), 1 - 1e-12)')} AS z FROM ({_ERAS}) WHERE size > 1) WINDOW e AS (PARTITION BY g, era)"
_REST = f"""SELECT *, {rank_of('rest', 'g, era')} AS rr FROM (SELECT g, era, size, yc, z - (za * bb - zb * ab) / (aa * bb - ab * ab) * a - (zb * aa - za * ab) / (aa * bb - ab * ab) * b AS rest
  FROM (SELECT *, sum(a * a) OVER e AS aa, sum(a * b) OVER e AS ab, sum(b * b) OVER e AS bb, sum(z * a) OVER e AS za, sum(z * b) OVER e AS zb FROM ({_CENTRED}) WINDOW e AS (PARTITION BY g, era)))"""

EXPECTED["samples"] = Expected(
    "side v x grp outcome y pa pb wa wb flag dp dq cx cy arm cov pv era p target meta f1 f2 rv",
    f"""
    lift: mb / ma - 1
    glass_delta: (ma - mb) / sb
    cohens_h: 2 * (asin(sqrt(ma)) - asin(sqrt(mb)))
    average_treatment_effect: ma - mb
    risk_difference: ma - mb
    relative_risk_reduction: 1 - ma / mb
    number_needed_to_treat: 1 / abs(ma - mb)
    standardized_mean_difference: (ma - mb) / sqrt((sa * sa + sb * sb) / 2)
    cliffs_delta: (wins - losses) / (na * nb)
    rank_biserial: (losses - wins) / (na * nb)
    common_language_effect_size: (1 + (wins - losses) / (na * nb)) / 2
    ansari_bradley: {total("least($rv, n + 1 - $rv)", "$side = 'a'")}
    wilcoxon_rank_sum: ({total("$rv", "$side = 'a'")} - na * (n + 1) / 2) / sqrt(na * nb * (n + 1) / 12)
    mood_test: ({total("pow($rv - (n + 1) / 2, 2)", "$side = 'a'")} - na * (n * n - 1) / 12) / sqrt(na * nb * (n + 1) * (n * n - 4) / 180)
    brunner_munzel: bm
    ks_2samp: ks
    wasserstein_1d: emd
    energy_distance: sqrt(2 * cvm)
    mood_median_test: pow(abs(aa - up * na / n) - 0.5, 2) * n * n / (up * (n - up) * na) + pow(abs(up - aa - up * nb / n) - 0.5, 2) * n * n / (up * (n - up) * nb)
    conditional_entropy: h_xy - h_x
    joint_entropy: h_xy
    variation_of_information: 2 * h_xy - h_x - h_y
    uncertainty_coefficient: CASE WHEN h_y > 1e-12 THEN mi / h_y END
    symmetric_uncertainty: CASE WHEN h_x + h_y > 1e-12 THEN 2 * mi / (h_x + h_y) END
    normalized_variation_of_information: (2 * h_xy - h_x - h_y) / h_xy
    eta_squared: ssb / (ssb + ssw)
    omega_squared: (ssb - (groups - 1) * msw) / (ssb + ssw + msw)
    epsilon_squared: (ssb - (groups - 1) * msw) / (ssb + ssw)
    cohens_f: sqrt(ssb / ssw)
    anova_statistic: ssb / (groups - 1) / msw
    jarque_bera_statistic: n / 6 * (pow({mean("pow($x - mx, 3)")}, 2) / pow({mean("pow($x - mx, 2)")}, 3) + pow({mean("pow($x - mx, 4)")} / pow({mean("pow($x - mx, 2)")}, 2) - 3, 2) / 4)
    information_value: iv
    bonferroni_rejections: {count("$pv <= 0.05 / n")}
    sidak_rejections: {count("$pv <= 1 - pow(0.95, 1 / n)")}
    bh_rejections: coalesce({top("i", "ps[i] <= 0.05 * i / n")}, 0)
    holm_rejections: coalesce({low("i", "ps[i] > 0.05 / (n - i + 1)")} - 1, n)
    holm_sidak_rejections: coalesce({low("i", "ps[i] > 1 - pow(0.95, 1 / (n - i + 1))")} - 1, n)
    hochberg_rejections: coalesce({top("i", "ps[i] <= 0.05 / (n - i + 1)")}, 0)
    benjamini_yekutieli: coalesce({top("i", "ps[i] <= 0.05 * i / (n * harmonic)")}, 0)
    point_biserial: {total("($flag - mf) * ($x - mx)")} / sqrt({total("pow($flag - mf, 2)")} * {total("pow($x - mx, 2)")})
    kl_divergence: {total("$fp * (ln($fp) - ln($fq))", "$fp > 0")}
    js_divergence: {total("CASE WHEN $fp > 0 THEN $fp * ln($fp / (($fp + $fq) / 2)) ELSE 0 END + CASE WHEN $fq > 0 THEN $fq * ln($fq / (($fp + $fq) / 2)) ELSE 0 END")} / 2
    hellinger_distance: sqrt({total("pow(sqrt($fp) - sqrt($fq), 2)")} / 2)
    total_variation_distance: {total("abs($fp - $fq)")} / 2
    bhattacharyya_distance: -ln({total("sqrt($fp) * sqrt($fq)")})
    jeffreys_divergence: {total("$fp * (ln($fp) - ln($fq))", "$fp > 0")} + {total("$fq * (ln($fq) - ln($fp))", "$fq > 0")}
    chi_square_distance: {total("pow($fp - $fq, 2) / ($fp + $fq)", "$fp + $fq > 0")}
    variance_reduction_cuped: pow({total("($v - mv) * ($cov - mc)")}, 2) / ({total("pow($v - mv, 2)")} * scc)
    cuped_ate: {mean("$v", "$arm = 1")} - {mean("$v", "$arm = 0")} - {total("($v - mv) * ($cov - mc)")} / scc * ({mean("$cov", "$arm = 1")} - {mean("$cov", "$arm = 0")})
    max_feature_exposure: greatest(abs({total("($p - mp) * ($f1 - m1)")}) / sqrt({total("pow($p - mp, 2)")} * {total("pow($f1 - m1, 2)")}), abs({total("($p - mp) * ($f2 - m2)")}) / sqrt({total("pow($p - mp, 2)")} * {total("pow($f2 - m2, 2)")}))
    p_value: {student_tail("abs(ma - mb) / sqrt(sa * sa / na + sb * sb / nb)", "pow(sa * sa / na + sb * sb / nb, 2) / (pow(sa * sa / na, 2) / (na - 1) + pow(sb * sb / nb, 2) / (nb - 1))")}
    effect_size: dd_
    hedges_g: dd_ * exp(lgamma((n - 2) / 2) - lgamma((n - 3) / 2)) / sqrt((n - 2) / 2)
    proportion_z: 2 * {upper_tail("abs(ma - mb) / sqrt((ma * na + mb * nb) / n * (1 - (ma * na + mb * nb) / n) * (1 / na + 1 / nb))")}
    mann_whitney: CASE WHEN na > 0 AND nb > 0 THEN least(1, {_TWO_SIDES("(abs(wins - losses) / 2 - 0.5) / sqrt(na * nb / 12 * (n + 1 - tie_sum / (n * (n - 1))))")}) END
    ks_test: CASE WHEN na > 0 AND nb > 0 THEN least(1, 2 * list_sum(list_transform(range(1, 101), lambda k: CASE WHEN k % 2 = 1 THEN 1 ELSE -1 END * exp(-2 * k * k * ks * ks * na * nb / n)))) END
    mcnemar: {chi_square_tail("pow(abs(" + count("$pa = 1 AND $pb = 0") + " - " + count("$pa = 0 AND $pb = 1") + ") - 1, 2) / " + count("$pa <> $pb"), "1")}
    wilcoxon_signed_rank: least(1, 2 * {upper_tail("abs(coalesce(w_up, 0) - w_n * (w_n + 1) / 4) / sqrt(w_n * (w_n + 1) * (2 * w_n + 1) / 24 - w_ties / 48)")})
    anova: CASE WHEN groups > 1 THEN pow(1 + (groups - 1) * ssb / (groups - 1) / msw / (n - groups), (groups - n) / 2) END
    bartlett: {chi_square_tail("((n - groups) * ln(ssw / (n - groups)) - log_var) / (1 + (inv_n - 1 / (n - groups)) / (3 * (groups - 1)))", "groups - 1")}
    levene: CASE WHEN groups > 1 THEN pow(1 + lev / (n - groups), (groups - n) / 2) END
    fligner: {chi_square_tail("flig", "groups - 1")}
    kruskal_wallis: {chi_square_tail("(12 / (n * (n + 1)) * krus - 3 * (n + 1)) / (1 - tie_sum / (n * n * n - n))", "groups - 1")}
    wilson_lower: (fl + pow(1.959963984540054, 2) / (2 * n) - 1.959963984540054 * sqrt(fl * (1 - fl) / n + pow(1.959963984540054 / n, 2) / 4)) / (1 + pow(1.959963984540054, 2) / n)
    wilson_upper: (fl + pow(1.959963984540054, 2) / (2 * n) + 1.959963984540054 * sqrt(fl * (1 - fl) / n + pow(1.959963984540054 / n, 2) / 4)) / (1 + pow(1.959963984540054, 2) / n)
    numerai_corr: era_mean
    numerai_sharpe: era_mean / era_sd
    mmc: mmc_mean
    feature_neutral_corr: neutral_mean
    """,
    windows=(
        f"{rank_of('v')} AS rv, {rank_of('v', 'g, side')} AS own_rank",
        "avg(rv) OVER (PARTITION BY g, side) AS mean_rank, count(*) OVER (PARTITION BY g, side) AS own_n",
    ),
    relations=(
        # pairs of a and b won and lost, from counts below each value
        """SELECT g, sum(k * below)::DOUBLE AS wins, sum(k * (others - upto))::DOUBLE AS losses FROM (
             SELECT g, v, count(*) FILTER (side = 'a') AS k, sum(count(*) FILTER (side = 'b')) OVER (PARTITION BY g) AS others,
                    sum(count(*) FILTER (side = 'b')) OVER (PARTITION BY g ORDER BY v) AS upto, sum(count(*) FILTER (side = 'b')) OVER (PARTITION BY g ORDER BY v) - count(*) FILTER (side = 'b') AS below
             FROM rows_ GROUP BY g, v) GROUP BY g""",
        """SELECT g, max(na) * max(nb) * (max(rb) - max(ra)) / ((max(na) + max(nb)) * sqrt(max(na) * max(va) + max(nb) * max(vb))) AS bm FROM (
             SELECT g, CASE WHEN side = 'a' THEN avg(rv) END AS ra, CASE WHEN side = 'b' THEN avg(rv) END AS rb, CASE WHEN side = 'a' THEN count(*) END AS na, CASE WHEN side = 'b' THEN count(*) END AS nb,
                    CASE WHEN side = 'a' THEN sum(pow(rv - own_rank - mean_rank + (own_n + 1) / 2, 2)) / (count(*) - 1) END AS va, CASE WHEN side = 'b' THEN sum(pow(rv - own_rank - mean_rank + (own_n + 1) / 2, 2)) / (count(*) - 1) END AS vb
             FROM rows_ GROUP BY g, side) GROUP BY g""",
        """SELECT g, max(abs(fa - fb)) AS ks, sum(abs(fa - fb) * step) AS emd, sum(pow(fa - fb, 2) * step) AS cvm FROM (
             SELECT g, sum(a) OVER up / sum(a) OVER (PARTITION BY g) AS fa, sum(b) OVER up / sum(b) OVER (PARTITION BY g) AS fb, lead(v) OVER up - v AS step
             FROM (SELECT g, v, count(*) FILTER (side = 'a') AS a, count(*) FILTER (side = 'b') AS b FROM rows_ GROUP BY g, v) WINDOW up AS (PARTITION BY g ORDER BY v)) GROUP BY g""",
        f"SELECT g, sum(k / all_ * ln(k * all_ / (ka * kb))) AS mi, -sum(k / all_ * ln(k / all_)) AS h_xy FROM ({cells('cx', 'cy')}) GROUP BY g",
        "SELECT g, entropy(cx) * ln(2) AS h_x, entropy(cy) * ln(2) AS h_y FROM rows_ GROUP BY g",
        "SELECT g, sum(k * pow(m - grand, 2)) AS ssb, sum(s2) AS ssw, count(*)::DOUBLE AS groups FROM (SELECT g, grp, count(*) AS k, avg(v) AS m, any_value(grand) AS grand, var_pop(v) * count(*) AS s2 FROM (SELECT *, avg(v) OVER (PARTITION BY g) AS grand FROM rows_) GROUP BY g, grp) GROUP BY g",
        "SELECT g, sum((good - bad) * ln(good / bad)) AS iv FROM (SELECT g, grp, count(*) FILTER (y = 0) / sum(count(*) FILTER (y = 0)) OVER (PARTITION BY g) AS good, count(*) FILTER (y = 1) / sum(count(*) FILTER (y = 1)) OVER (PARTITION BY g) AS bad FROM rows_ GROUP BY g, grp) WHERE good > 0 AND bad > 0 GROUP BY g",
        "SELECT g, sum(k * k * k - k)::DOUBLE AS tie_sum FROM (SELECT g, v, count(*) AS k FROM rows_ GROUP BY g, v) GROUP BY g",
        """SELECT g, sum(place) FILTER (up) AS w_up, count(*)::DOUBLE AS w_n, sum(same * same - 1)::DOUBLE AS w_ties FROM (
             SELECT g, up, rank() OVER (PARTITION BY g ORDER BY d) + (count(*) OVER (PARTITION BY g, d) - 1) / 2 AS place, count(*) OVER (PARTITION BY g, d) AS same FROM (SELECT g, wa > wb AS up, abs(wa - wb) AS d FROM rows_ WHERE wa <> wb)) GROUP BY g""",
        "SELECT g, sum((k - 1) * ln(s2)) AS log_var, sum(1 / (k - 1)) AS inv_n FROM (SELECT g, grp, count(*)::DOUBLE AS k, var_samp(v) AS s2 FROM rows_ GROUP BY g, grp) GROUP BY g",
        # spread between the groups' mean distances over the spread within them; levene is the ratio of sums times the inner degrees of freedom
        "SELECT g, sum(k * pow(m - grand, 2)) / sum(s2) * (sum(k) - count(*)) AS lev FROM (SELECT g, grp, count(*) AS k, avg(away) AS m, any_value(grand) AS grand, var_pop(away) * count(*) AS s2 FROM (SELECT *, avg(away) OVER (PARTITION BY g) AS grand FROM (" + _AWAY + ")) GROUP BY g, grp) GROUP BY g",
        "SELECT g, sum(k * pow(m - grand, 2)) / any_value(s2) AS flig FROM (SELECT g, grp, count(*) AS k, avg(a) AS m, any_value(grand) AS grand, any_value(s2) AS s2 FROM (SELECT *, avg(a) OVER (PARTITION BY g) AS grand, var_samp(a) OVER (PARTITION BY g) AS s2 FROM (SELECT g, grp, "
        + normal_quantile("0.5 + place / (2 * (nn + 1))")
        + " AS a FROM (" + _AWAY + "))) GROUP BY g, grp) GROUP BY g",
        "SELECT g, sum(r * r / k) AS krus FROM (SELECT g, grp, sum(rv) AS r, count(*) AS k FROM rows_ GROUP BY g, grp) GROUP BY g",
        f"SELECT g, avg(c) AS era_mean, stddev_pop(c) AS era_sd FROM (SELECT g, era, corr({_bent('z')}, {_bent('yc')}) AS c FROM (SELECT *, {_NORMAL_SCORE} AS z FROM ({_ERAS}) WHERE size > 1) GROUP BY g, era) GROUP BY g",
        f"""SELECT g, avg(v) AS mmc_mean FROM (SELECT g, era, (sum(y * a) - sum(a * b) / sum(b * b) * sum(y * b)) / count(*) AS v FROM (
              SELECT g, era, yc * CASE WHEN lo >= 0 AND hi <= 1 THEN 4 ELSE 1 END AS y, {normal_quantile('(rp - 0.5) / size')} AS a, {normal_quantile('(rm - 0.5) / size')} AS b FROM ({_ERAS}) WHERE size > 1) GROUP BY g, era) GROUP BY g""",
        f"SELECT g, avg(c) AS neutral_mean FROM (SELECT g, era, corr({_bent('z2')}, {_bent('yc')}) AS c FROM (SELECT *, {normal_quantile('least(greatest((rr - 0.5) / size, 1e-6), 1 - 1e-6)')} AS z2 FROM ({_REST})) GROUP BY g, era) GROUP BY g",
    ),
    layers=(
        {
            "ma": mean("$v", "$side = 'a'"),
            "mb": mean("$v", "$side = 'b'"),
            "sa": spread("$v", "$side = 'a'"),
            "sb": spread("$v", "$side = 'b'"),
            "na": count("$side = 'a'"),
            "nb": count("$side = 'b'"),
            "med": "list_median(v)",
            "ps": "list_sort(pv)",
            "harmonic": total("1 / i"),
            "msw": "ssw / (n - groups)",
            "mf": "list_avg(flag)",
            "mx": "list_avg(x)",
            "mv": "list_avg(v)",
            "mc": "list_avg(cov)",
            "mp": "list_avg(p)",
            "m1": "list_avg(f1)",
            "m2": "list_avg(f2)",
            "sp": "list_sum(dp)",
            "sq": "list_sum(dq)",
        },
        {"fp": "list_transform(dp, lambda z: z / sp)", "fq": "list_transform(dq, lambda z: z / sq)"},
        {"fl": share("$flag <> 0"), "dd_": "(ma - mb) / sqrt(((na - 1) * sa * sa + (nb - 1) * sb * sb) / (n - 2))", "up": count("$v > med"), "aa": count("$v > med AND $side = 'a'"), "scc": total("pow($cov - mc, 2)")},
    ),
)

# --- rankings --------------------------------------------------------------------
#: One row for each query: relevances in order of rank, and the number of relevant ones.
_RANKED = "SELECT g, query, max(max(rel)) OVER (PARTITION BY g) AS most, list(rel ORDER BY rank, pos) AS rels, count(*) FILTER (rel > 0)::DOUBLE AS wanted, count(*)::DOUBLE AS k FROM rows_ GROUP BY g, query"


def first(term: str, k: str = "10") -> str:
    """Sum of a term over the first k places of a query; ``rels[i]`` is the relevance at place i."""
    return f"coalesce(list_sum(list_transform(range(1, least({k}, k)::BIGINT + 1), lambda i: ({term})::DOUBLE)), 0)"


_HITS = first("(rels[i] > 0)::INT")
_PRECISION = "CASE WHEN rels[i] > 0 THEN len(list_filter(rels[:i], lambda z: z > 0)) / i ELSE 0 END"
_STOP = "(pow(2, rels[i]) - 1) / pow(2, most)"
EXPECTED["rankings"] = Expected(
    "rel",
    """
    recall_at_k: v_recall
    top_k_accuracy: v_top5
    precision_at_k: v_precision
    map_at_k: v_map10
    mean_average_precision: v_map
    f1_at_k: v_f1
    fallout_at_k: v_fallout
    success_at_k: v_success
    arhr_at_k: v_arhr
    mrr: v_mrr
    r_precision: v_r
    rbp: v_rbp
    ndcg_at_k: v_ndcg
    err_at_k: v_err
    """,
    relations=(
        f"""SELECT g, avg(hits / nullif(wanted, 0)) AS v_recall, avg((hits5 > 0)::INT) AS v_top5, avg(hits / 10) AS v_precision, avg(ap10 / nullif(least(wanted, 10), 0)) AS v_map10, avg(ap / nullif(wanted, 0)) AS v_map,
              avg(CASE WHEN wanted > 0 THEN 2 * hits / (10 + wanted) END) AS v_f1, avg((least(k, 10) - hits) / nullif(k - wanted, 0)) AS v_fallout, avg((hits > 0)::INT) AS v_success, avg(arhr) AS v_arhr, avg(rr) AS v_mrr, avg(rhits / nullif(wanted, 0)) AS v_r,
              avg(rbp) AS v_rbp, avg(dcg / idcg) FILTER (idcg > 0) AS v_ndcg, CASE WHEN max(most) > 0 THEN avg(err) END AS v_err
            FROM (SELECT g, wanted, k, most, {_HITS} AS hits, {first("(rels[i] > 0)::INT", "5")} AS hits5, {first(_PRECISION)} AS ap10, {first(_PRECISION, "k")} AS ap, {first("(rels[i] > 0)::INT / i")} AS arhr,
                    coalesce(1 / nullif(list_position(list_transform(rels, lambda z: z > 0), true), 0), 0) AS rr, {first("(rels[i] > 0)::INT", "wanted")} AS rhits, {first("(rels[i] > 0)::INT * 0.2 * pow(0.8, i - 1)", "k")} AS rbp,
                    {first("rels[i] * ln(2) / ln(i + 1)")} AS dcg, {first("list_reverse_sort(rels)[i] * ln(2) / ln(i + 1)")} AS idcg,
                    {first(f"{_STOP} / i * coalesce(list_product(list_transform(rels[:i - 1], lambda z: 1 - (pow(2, z) - 1) / pow(2, most))), 1)")} AS err FROM ({_RANKED})) GROUP BY g""",
    ),
)

# --- answers and strings -----------------------------------------------------------
EXPECTED["answers"] = Expected(
    "problem correct lp",
    """
    perplexity: 1 / exp(list_avg(lp))
    pass_at_k: solved
    """,
    relations=("SELECT g, avg(rate) AS solved FROM (SELECT g, problem, avg(correct) AS rate FROM rows_ GROUP BY g, problem) GROUP BY g",),
)
def tokens(c: str, by: str = "\\s+") -> str:
    return f"list_filter(string_split_regex({c}, '{by}'), lambda w: w <> '')"


def plain(c: str) -> str:
    return f"list_filter({tokens(f'lower({c})', '[^\\pL\\pN]+')}, lambda w: w NOT IN ('a', 'an', 'the'))"


def letters(c: str) -> str:
    """A text with one letter for each word, so that edits of words are edits of letters."""
    return f"list_reduce(list_prepend('', list_transform({tokens(c)}, lambda w: chr((33 + list_position(list_distinct(list_concat({tokens('$tp')}, {tokens('$tr')})), w))::INT))), lambda a, b: a || b)"


_CHARS = "string_split({}, '')".format
_BOTH = f"len(list_intersect({tokens('$tp')}, {tokens('$tr')}))"
EXPECTED["strings"] = Expected(
    "tp tr",
    f"""
    wer: {total(f"editdist3({letters('$tr')}, {letters('$tp')})")} / {total(f"len({tokens('$tr')})")}
    token_f1: {mean(f"2 * list_sum(list_transform(list_distinct({plain('$tp')}), lambda w: least(len(list_filter({plain('$tp')}, lambda v: v = w)), len(list_filter({plain('$tr')}, lambda v: v = w))))) / (len({plain('$tp')}) + len({plain('$tr')}))")}
    indel_similarity: {mean(f"2 * {subsequence(_CHARS('$tp'), _CHARS('$tr'))} / (length($tp) + length($tr))")}
    jaro_similarity: {mean("jaro_similarity($tp, $tr)")}
    jaro_winkler_similarity: {mean("jaro_winkler_similarity($tp, $tr)")}
    longest_common_subsequence: {mean(subsequence(_CHARS("$tp"), _CHARS("$tr")))}
    token_jaccard: {mean(f"{_BOTH} / len(list_distinct(list_concat({tokens('$tp')}, {tokens('$tr')})))")}
    token_dice: {mean(f"2 * {_BOTH} / (len(list_distinct({tokens('$tp')})) + len(list_distinct({tokens('$tr')})))")}
    exact_match_normalized: {share(f"{plain('$tp')} = {plain('$tr')}")}
    cer: {total("editdist3($tp, $tr)")} / {total("length($tr)")}
    levenshtein_similarity: {mean("1 - editdist3($tp, $tr) / greatest(length($tp), length($tr))")}
    exact_match: {share("trim($tp) = trim($tr)")}
    """,
)

# --- flows -----------------------------------------------------------------------
Y = "0.05"


def present(y: str, weight: str = "1") -> str:
    return total(f"{weight} * $cf * exp(-$tm * ln(1 + {y}))")


EXPECTED["flows"] = Expected(
    "cf tm z contribution distribution idx",
    f"""
    dpi: list_sum(distribution) / called
    rvpi: 10000 / called
    called_pct: called / 1000000
    tvpi: (list_sum(distribution) + 10000) / called
    carried_interest: 0.2 * greatest(0, list_sum(distribution) - called)
    realization_ratio: list_sum(distribution) / (list_sum(distribution) + 10000)
    ks_pme: ({total("$distribution * idx[-1] / $idx")} + 1000) / {total("$contribution * idx[-1] / $idx")}
    pme_plus_lambda: {total("$contribution / $idx")} / {total("$distribution / $idx")}
    bond_price: pv
    macaulay_duration: {present(Y, "$tm")} / pv
    modified_duration: {present(Y, "$tm")} / pv / 1.05
    convexity: {present(Y, "$tm * ($tm + 1)")} / (pv * 1.1025)
    dv01: {present(Y, "$tm")} / 1.05 / 10000
    weighted_average_life: {total("$tm * $cf")} / list_sum(cf)
    effective_duration: ({present("0.0499")} - {present("0.0501")}) / (0.0002 * pv)
    effective_convexity: ({present("0.0501")} + {present("0.0499")} - 2 * pv) / (1e-8 * pv)
    curve_pv: cv
    spread_duration: (cv_down - cv_up) / (0.0002 * cv)
    spread_dv01: (cv_down - cv_up) / 2
    annuity_factor: annuity
    par_yield: (1 - pow(1 + z[-1], -tm[-1])) / annuity
    forward_rate: pow(pow(1 + z[-1], tm[-1]) / pow(1 + z[-2], tm[-2]), 1 / nullif(tm[-1] - tm[-2], 0)) - 1
    npv: worth
    profitability_index: CASE WHEN cf[1] < 0 THEN 1 - worth / cf[1] END
    equivalent_annual_annuity: worth * 0.1 / (1 - pow(1.1, 1 - n))
    modified_irr: pow({total("CASE WHEN $cf > 0 THEN $cf * pow(1.1, n - i) ELSE 0 END")} / {total("CASE WHEN $cf < 0 THEN -$cf * pow(1.1, 1 - i) ELSE 0 END")}, 1 / (n - 1)) - 1
    yield_to_maturity: {bisected(total("$cf * exp(-$tm * ln(1 + @))") + " - 100", "-0.9999", "10", 200)}
    z_spread: {bisected(total("$cf * exp(-$tm * ln(1 + $z + @))") + " - 100", "-0.5", "5", 200)}
    irr: {bisected(total("$cf * exp(-ln(1 + @) * (i - CASE WHEN @ > 0 THEN 1 ELSE n END))"), "-0.9999", "1000000", 200)}
    direct_alpha: {bisected(total("($distribution - $contribution) / $idx * exp(-ln(1 + @) * (i - CASE WHEN @ > 0 THEN 1 ELSE n END))"), "-0.9999", "1000000", 200)}
    """,
    layers=(
        {
            "called": "list_sum(contribution)",
            "pv": present(Y),
            "cv": total("$cf * pow(1 + $z, -$tm)"),
            "cv_up": total("$cf * pow(1.0001 + $z, -$tm)"),
            "cv_down": total("$cf * pow(0.9999 + $z, -$tm)"),
            "annuity": total("pow(1 + $z, -$tm)"),
            "worth": total("$cf * pow(1.1, 1 - i)"),
        },
    ),
)

# --- accounts --------------------------------------------------------------------
AVG = "list_avg({}) / list_avg({})".format
_STRESSED = normal(f"({normal_quantile('$pd')} + sqrt(0.15) * {normal_quantile('0.999')}) / sqrt(0.85)")
EXPECTED["accounts"] = Expected(
    "revenue cogs net_income assets equity nopat invested_capital receivables operating_income fcf dividends inventory payables ebit lease interest interest_expense contribution distribution idx value cost value_a value_b flag x ebitda debt cash current_assets "
    "current_liabilities pd lgd ead recovery exposure maturity x1 x2 x3 x4 x5 wc_ta ebit_ta ebt_cl sales_ta roa tl_ta ca_cl capital rwa tier1_capital total_exposure provisions npl spread asset_value drift vol tm",
    f"""
    margin_pct: 1 - {AVG("cost", "value")}
    reconciliation_total: {total("$value_a - $value_b")}
    return_on_equity: {AVG("net_income", "equity")}
    return_on_assets: {AVG("net_income", "assets")}
    return_on_invested_capital: {AVG("nopat", "invested_capital")}
    asset_turnover: {AVG("revenue", "assets")}
    days_sales_outstanding: 365 * {AVG("receivables", "revenue")}
    operating_margin: {AVG("operating_income", "revenue")}
    net_margin: {AVG("net_income", "revenue")}
    free_cash_flow_margin: {AVG("fcf", "revenue")}
    dividend_payout_ratio: {AVG("dividends", "net_income")}
    days_inventory_outstanding: 365 * {AVG("inventory", "cogs")}
    days_payable_outstanding: 365 * {AVG("payables", "cogs")}
    cash_conversion_cycle: 365 * {AVG("receivables", "revenue")} + 365 * {AVG("inventory", "cogs")} - 365 * {AVG("payables", "cogs")}
    fixed_charge_coverage: {total("$ebit + $lease")} / {total("$interest + $lease")}
    churn_rate: {share("$flag <> 0")}
    cagr: CASE WHEN n > 1 THEN pow(x[-1] / x[1], 1 / (n - 1)) - 1 END
    expected_loss: {total("$pd * $lgd * $ead")}
    expected_loss_rate: {total("$pd * $lgd * $ead")} / list_sum(ead)
    unexpected_loss: {total("$ead * $lgd * sqrt($pd - $pd * $pd)")}
    weighted_lgd: {total("$lgd * $ead")} / list_sum(ead)
    altman_z: {mean("1.2 * $x1 + 1.4 * $x2 + 3.3 * $x3 + 0.6 * $x4 + $x5")}
    altman_z_prime: 6.56 * list_avg(x1) + 3.26 * list_avg(x2) + 6.72 * list_avg(x3) + 1.05 * list_avg(x4)
    altman_z_double_prime: 3.25 + 6.56 * list_avg(x1) + 3.26 * list_avg(x2) + 6.72 * list_avg(x3) + 1.05 * list_avg(x4)
    recovery_rate: {AVG("recovery", "exposure")}
    exposure_weighted_pd: {total("$pd * $ead")} / list_sum(ead)
    exposure_weighted_maturity: {total("$maturity * $ead")} / list_sum(ead)
    current_ratio: {AVG("current_assets", "current_liabilities")}
    quick_ratio: {total("$current_assets - $inventory")} / list_sum(current_liabilities)
    interest_coverage: {AVG("ebit", "interest_expense")}
    debt_to_equity: {AVG("debt", "equity")}
    debt_to_ebitda: {AVG("debt", "ebitda")}
    net_debt_to_ebitda: {total("$debt - $cash")} / list_sum(ebitda)
    ebitda_margin: {AVG("ebitda", "revenue")}
    springate_score: 1.03 * list_avg(wc_ta) + 3.07 * list_avg(ebit_ta) + 0.66 * list_avg(ebt_cl) + 0.4 * list_avg(sales_ta)
    zmijewski_score: -4.336 - 4.513 * list_avg(roa) + 5.679 * list_avg(tl_ta) + 0.004 * list_avg(ca_cl)
    capital_adequacy_ratio: {AVG("capital", "rwa")}
    tier1_leverage_ratio: {AVG("tier1_capital", "total_exposure")}
    provision_coverage_ratio: {AVG("provisions", "npl")}
    cds_implied_hazard: {mean("$spread / (1 - $recovery)")}
    merton_distance_to_default: {mean("(ln($asset_value) - ln($debt) + ($drift - $vol * $vol / 2) * $tm) / ($vol * sqrt($tm))")}
    merton_pd: {mean(normal("-((ln($asset_value) - ln($debt) + ($drift - $vol * $vol / 2) * $tm) / ($vol * sqrt($tm)))"))}
    asrf_capital_requirement: {total(f"$ead * $lgd * ({_STRESSED} - $pd)")}
    asrf_rwa: 12.5 * {total(f"$ead * $lgd * ({_STRESSED} - $pd)")}
    vasicek_conditional_pd: {mean(_STRESSED)}
    """,
)

# --- trades ----------------------------------------------------------------------
_BETA_ = "(pow(ln($high / $low), 2) + pow(ln(high[i + 1] / low[i + 1]), 2))"
_ALPHA_ = f"((sqrt(2) - 1) * sqrt({_BETA_}) / (3 - 2 * sqrt(2)) - ln(greatest($high, high[i + 1]) / least($low, low[i + 1])) / sqrt(3 - 2 * sqrt(2)))"


def slip(price: str, against: str, times: int = 1) -> str:
    return f"{times} * 10000 * ({total(f'$quantity * ${price}')} / {total(f'$quantity * ${against}')} - 1)"


EXPECTED["trades"] = Expected(
    "port_weight bench_weight port_return bench_return curr_weight prev_weight weight exposure days_to_liquidate ret dollar_volume price_change signed_volume price volume bid ask buy_volume sell_volume shares_outstanding high low close exec_price decision_price "
    "arrival_price vwap_price mid_price mid_future_price quantity order_volume market_volume",
    f"""
    brinson_allocation: {total("$port_weight * $bench_return")} - rb
    brinson_selection: {total("$bench_weight * $port_return")} - rb
    brinson_interaction: rp - {total("$port_weight * $bench_return")} - {total("$bench_weight * $port_return")} + rb
    brinson_total_active: rp - rb
    active_share: {total("abs($port_weight - $bench_weight)")} / 2
    portfolio_turnover: {total("abs($curr_weight - $prev_weight)")} / 2
    effective_number_of_bets: pow(list_sum(weight), 2) / {total("pow($weight, 2)")}
    brinson_fachler_allocation: {total("($port_weight - $bench_weight) * ($bench_return - rb)")}
    geometric_excess_return: (rp - rb) / (1 + rb)
    amihud_illiquidity: {mean("abs($ret) / $dollar_volume")}
    amivest_liquidity: {total("$dollar_volume", "$ret <> 0")} / {total("abs($ret)")}
    kyle_lambda: {total("($price_change - mpc) * ($signed_volume - msv)")} / {total("pow($signed_volume - msv, 2)")}
    vwap: {total("$price * $volume")} / list_sum(volume)
    relative_spread: {mean("2 * ($ask - $bid) / ($ask + $bid)")}
    order_flow_imbalance: {total("$buy_volume - $sell_volume")} / {total("$buy_volume + $sell_volume")}
    share_turnover: {AVG("volume", "shares_outstanding")}
    roll_spread: CASE WHEN serial < 0 THEN 2 * sqrt(-serial) END
    corwin_schultz_spread: {mean(f"CASE WHEN {_ALPHA_} > 0 THEN 2 * (exp({_ALPHA_}) - 1) / (exp({_ALPHA_}) + 1) ELSE 0 END", "i < n")}
    abdi_ranaldo_spread: CASE WHEN n > 1 AND list_min(close) > 0 AND list_min(low) > 0 AND list_min(high) > 0 THEN 2 * sqrt(greatest(0, {mean("(ln($close) - ln($high * $low) / 2) * (ln($close) - ln(high[i + 1] * low[i + 1]) / 2)", "i < n")})) END
    gross_exposure: {total("abs($exposure)")}
    net_exposure: list_sum(exposure)
    long_exposure: coalesce({total("$exposure", "$exposure > 0")}, 0)
    short_exposure: -coalesce({total("$exposure", "$exposure < 0")}, 0)
    long_short_ratio: coalesce({total("$exposure", "$exposure > 0")}, 0) / -{total("$exposure", "$exposure < 0")}
    largest_position: {top("abs($exposure)")} / {total("abs($exposure)")}
    liquidity_coverage: coalesce({total("abs($weight)", "$days_to_liquidate <= 5")}, 0) / {total("abs($weight)")}
    implementation_shortfall: {slip("exec_price", "decision_price")}
    arrival_slippage: {slip("exec_price", "arrival_price")}
    vwap_slippage: {slip("exec_price", "vwap_price")}
    effective_spread_bps: {slip("exec_price", "mid_price", 2)}
    realized_spread_bps: {slip("exec_price", "mid_future_price", 2)}
    price_impact_bps: {slip("mid_future_price", "mid_price", 2)}
    participation_rate: {AVG("order_volume", "market_volume")}
    """,
    relations=(
        "SELECT g, covar_samp(d, lag_d) AS serial FROM (SELECT g, d, lag(d) OVER (PARTITION BY g ORDER BY pos) AS lag_d FROM (SELECT g, pos, price - lag(price) OVER (PARTITION BY g ORDER BY pos) AS d FROM rows_) WHERE d IS NOT NULL) GROUP BY g",
    ),
    layers=({"rp": total("$port_weight * $port_return"), "rb": total("$bench_weight * $bench_return"), "mpc": "list_avg(price_change)", "msv": "list_avg(signed_volume)"},),
)

# --- options ---------------------------------------------------------------------
D1 = "((ln($spot / $strike) + ($rate + $vol * $vol / 2) * $tm) / ($vol * sqrt($tm)))"
D2 = f"({D1} - $vol * sqrt($tm))"
DENSITY = f"(exp(-pow({D1}, 2) / 2) / sqrt(2 * {PI}))"


def book(term: str) -> str:
    return total(f"$quantity * ({term})")


_CALL = f"($spot * {normal(D1)} - $strike * exp(-$rate * $tm) * {normal(D2)})"
EXPECTED["options"] = Expected(
    "spot strike tm vol rate quantity price",
    f"""
    bs_gamma: {book(f"{DENSITY} / ($spot * $vol * sqrt($tm))")}
    bs_vega: {book(f"$spot * sqrt($tm) * {DENSITY}")}
    bs_vanna: {book(f"-{DENSITY} * {D2} / $vol")}
    bs_volga: {book(f"$spot * sqrt($tm) * {DENSITY} * {D1} * {D2} / $vol")}
    bs_speed: {book(f"-{DENSITY} / ($spot * $spot * $vol * sqrt($tm)) * (1 + {D1} / ($vol * sqrt($tm)))")}
    bs_zomma: {book(f"{DENSITY} / ($spot * $vol * $vol * sqrt($tm)) * ({D1} * {D2} - 1)")}
    bs_charm: {book(f"{DENSITY} * ({D2} / (2 * $tm) - $rate / ($vol * sqrt($tm)))")}
    bs_color: {book(f"-{DENSITY} / (2 * $spot * $tm * $vol * sqrt($tm)) * (1 + {D1} * (2 * $rate * sqrt($tm) / $vol - {D2}))")}
    bs_veta: {book(f"$spot * {DENSITY} * sqrt($tm) * ($rate * {D1} / ($vol * sqrt($tm)) - (1 + {D1} * {D2}) / (2 * $tm))")}
    bs_ultima: {book(f"-$spot * sqrt($tm) * {DENSITY} / ($vol * $vol) * ({D1} * {D2} - pow({D1} * {D2}, 2) + pow({D1}, 2) + pow({D2}, 2))")}
    bs_value: {book(_CALL)}
    bs_delta: {book(normal(D1))}
    bs_theta: {book(f"-$spot * {DENSITY} * $vol / (2 * sqrt($tm)) - $rate * $strike * exp(-$rate * $tm) * {normal(D2)}")}
    bs_rho: {book(f"$strike * $tm * exp(-$rate * $tm) * {normal(D2)}")}
    bs_lambda: {book(f"$spot * {normal(D1)}")} / {book(_CALL)}
    bs_implied_vol: {mean(bisected(_CALL.replace("$vol", "@") + " - $price", "0.000001", "10", 60))}
    """,
)

# --- the trusted catalogue ---------------------------------------------------------
def classes(term: str, how: str = "avg") -> str:
    return f"list_{how}(list_transform(cell, lambda c: ({term})::DOUBLE))"


_P, _R, _F = "CASE WHEN c.p > 0 THEN c.hit / c.p ELSE 0 END", "CASE WHEN c.t > 0 THEN c.hit / c.t ELSE 0 END", "2 * c.hit / (c.t + c.p)"
EXPECTED["catalog"] = Expected(
    "y p x r b rel dd rx rr",
    f"""
    catalog_accuracy: hit / n
    catalog_mse: mse
    catalog_rmse: sqrt(mse)
    catalog_mae: {mean("abs($p - $y)")}
    catalog_r2: 1 - mse * n / {total("pow($y - my, 2)")}
    catalog_precision: coalesce({classes("CASE WHEN c.k = 1 THEN " + _P + " END", "max")}, 0)
    catalog_recall: coalesce({classes("CASE WHEN c.k = 1 THEN " + _R + " END", "max")}, 0)
    catalog_f1: coalesce({classes("CASE WHEN c.k = 1 THEN " + _F + " END", "max")}, 0)
    catalog_precision_macro: {classes(_P)}
    catalog_recall_macro: {classes(_R)}
    catalog_f1_macro: {classes(_F)}
    catalog_precision_micro: hit / n
    catalog_recall_micro: hit / n
    catalog_f1_micro: hit / n
    catalog_precision_weighted: {classes("c.t * " + f"({_P})", "sum")} / n
    catalog_recall_weighted: {classes("c.t * " + f"({_R})", "sum")} / n
    catalog_f1_weighted: {classes("c.t * " + f"({_F})", "sum")} / n
    catalog_balanced_accuracy: {classes("CASE WHEN c.t > 0 THEN c.hit / c.t END")}
    catalog_mcc: (n * hit - chance) / sqrt((n * n - {classes("c.p * c.p", "sum")}) * (n * n - {classes("c.t * c.t", "sum")}))
    catalog_cohen_kappa: (hit / n - chance / (n * n)) / (1 - chance / (n * n))
    catalog_mean: list_avg(x)
    catalog_sum: list_sum(x)
    catalog_stdev: sqrt({total("pow($x - mx, 2)")} / (n - 1))
    catalog_variance: {total("pow($x - mx, 2)")} / (n - 1)
    catalog_sharpe: CASE WHEN {total("pow($r - mr, 2)")} / (n - 1) >= 1e-24 THEN list_avg(r) / sqrt({total("pow($r - mr, 2)")} / (n - 1)) END
    catalog_sortino: list_avg(r) / sqrt({mean("CASE WHEN $r < 0 THEN $r * $r ELSE 0 END")})
    catalog_calmar: CASE WHEN list_product(list_transform(r, lambda z: 1 + z)) > 0 THEN (pow(list_product(list_transform(r, lambda z: 1 + z)), 252 / n) - 1) / -list_min(dd) END
    catalog_information_ratio: {mean("$r - $b")} / {spread("$r - $b")}
    catalog_correlation: {total("($x - mx) * ($y - my)")} / sqrt({total("pow($x - mx, 2)")} * {total("pow($y - my, 2)")})
    catalog_correlation_spearman: {total("($rx - (n + 1) / 2) * ($rr - (n + 1) / 2)")} / sqrt({total("pow($rx - (n + 1) / 2, 2)")} * {total("pow($rr - (n + 1) / 2, 2)")})
    catalog_correlation_kendall: tau
    catalog_ndcg: {total("$rel * ln(2) / ln(i + 1)")} / {total("best[i] * ln(2) / ln(i + 1)")}
    catalog_mrr: coalesce(1 / {low("i", "$rel > 0")}, 0)
    catalog_recall_at_k: CASE WHEN {count("$rel > 0")} > 0 THEN 1 END
    catalog_precision_at_k: {share("$rel > 0")}
    catalog_hit_at_k: ({count("$rel > 0")} > 0)::INT
    catalog_average_precision: {mean("len(list_filter(rel[:i], lambda z: z > 0)) / i", "$rel > 0")}
    """,
    windows=(
        f"product(1 + r) OVER (PARTITION BY g ORDER BY pos) AS eq, {rank_of('x')} AS rx, {rank_of('y')} AS rr",
        "eq / greatest(1, max(eq) OVER (PARTITION BY g ORDER BY pos)) - 1 AS dd",
    ),
    relations=(
        "SELECT g, list({'k': k, 't': t, 'p': p, 'hit': hit}) AS cell FROM (SELECT g, k, sum(t)::DOUBLE AS t, sum(p)::DOUBLE AS p, sum(hit)::DOUBLE AS hit FROM (SELECT g, y AS k, 1 AS t, 0 AS p, (p = y)::INT AS hit FROM rows_ UNION ALL SELECT g, p, 0, 1, 0 FROM rows_) GROUP BY g, k) GROUP BY g",
        "SELECT g, sum(sign((v.x - u.x) * (v.y - u.y))) / sqrt(sum(abs(sign(v.x - u.x))) * sum(abs(sign(v.y - u.y)))) AS tau FROM rows_ u JOIN rows_ v USING (g) WHERE u.pos < v.pos GROUP BY g",
    ),
    layers=(
        {"my": "list_avg(y)", "mx": "list_avg(x)", "mr": "list_avg(r)", "best": "list_reverse_sort(rel)", "mse": mean("pow($p - $y, 2)"), "hit": count("$p = $y"), "chance": classes("c.t * c.p", "sum")},
    ),
)
EXPECTED["catalog_scores"] = Expected(
    "y s",
    f"""
    catalog_roc_auc: area
    catalog_brier: {mean("pow($s - $y, 2)")}
    """,
    windows=(f"{rank_of('s')} AS mid",),
    relations=("SELECT g, (sum(mid) FILTER (y = 1) - sum(y) * (sum(y) + 1) / 2) / (sum(y) * (count(*) - sum(y))) AS area FROM rows_ GROUP BY g",),
)
