"""Return series, risk and volatility."""

from ..recipes import define, nearby, running, source, with_totals

CUM = "PARTITION BY g ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
W = "PARTITION BY g ORDER BY pos"

# products of 1 + r: magnitudes by logarithms, signs by parity, and zero for good after a loss of everything
MAGNITUDE, NEGATIVE, NOTHING = "sum(ln(nullif(abs(1 + r), 0)))", "sum(CASE WHEN r < -1 THEN 1 ELSE 0 END)", "sum(CASE WHEN r = -1 THEN 1 ELSE 0 END)"
PRODUCT = lambda m, negative, nothing: f"(CASE WHEN {nothing} > 0 THEN 0e0 WHEN {negative} % 2 = 1 THEN -exp({m}) ELSE exp({m}) END)"
running("factors", "{t}", "pos, r", magnitude=MAGNITUDE, negative=NEGATIVE, nothing=NOTHING)
EQUITY = PRODUCT("magnitude", "negative", "nothing")
source("equity", f"SELECT g, pos, r, {EQUITY} AS eq FROM {{factors}} q0", f"SELECT g, blk, nth, pos, r, {EQUITY} AS eq FROM {{factors}} q0")
running("peaks", "{equity}", "pos, r, eq", peak="max(eq)")
DEPTH = "eq / greatest(1e0, peak) - 1 AS dd"
source("drawdown", f"SELECT g, pos, r, eq, {DEPTH} FROM {{peaks}} q1", f"SELECT g, blk, nth, pos, r, eq, {DEPTH} FROM {{peaks}} q1")
GROWTH = PRODUCT(MAGNITUDE, NEGATIVE, NOTHING)
# no yearly rate of a series that ends with nothing or less
ANN = f"(CASE WHEN {GROWTH} > 0 THEN power({GROWTH}, {{P}} / count(*)) - 1 END)"

define("quant", "return=r", f"""
total_return: {GROWTH} - 1
sharpe[P=252]: CASE WHEN stddev_samp(r) > 0 THEN avg(r) / stddev_samp(r) * sqrt({{P}}) END
volatility[P=252]: stddev_samp(r) * sqrt({{P}})
downside_deviation[P=252]: sqrt(avg(power(least(r, 0), 2))) * sqrt({{P}})
sortino[P=252]: CASE WHEN count(*) > 1 THEN avg(r) / nullif(sqrt(avg(power(least(r, 0), 2))), 0) * sqrt({{P}}) END
win_rate: avg(CASE WHEN r > 0 THEN 1e0 ELSE 0e0 END)
profit_factor: sum(r) FILTER (WHERE r > 0) / nullif(abs(sum(r) FILTER (WHERE r < 0)), 0)
omega_ratio[threshold=0e0]: sum(greatest(r - {{threshold}}, 0)) / nullif(sum(greatest({{threshold}} - r, 0)), 0)
gain_to_pain_ratio: sum(r) / nullif(abs(sum(r) FILTER (WHERE r < 0)), 0)
gain_loss_ratio: avg(r) FILTER (WHERE r > 0) / nullif(abs(avg(r) FILTER (WHERE r < 0)), 0)
win_loss_ratio: count_if(r > 0) / nullif(count_if(r < 0), 0)
kelly_criterion: count_if(r > 0) / nullif(count_if(r > 0) + count_if(r < 0), 0)
  - count_if(r < 0) / nullif(count_if(r > 0) + count_if(r < 0), 0) / nullif(avg(r) FILTER (WHERE r > 0) / abs(avg(r) FILTER (WHERE r < 0)), 0)
upside_deviation[P=252]: sqrt(avg(power(greatest(r, 0), 2))) * sqrt({{P}})
upside_potential_ratio: avg(greatest(r, 0)) / nullif(sqrt(avg(power(least(r, 0), 2))), 0)
kappa_three: avg(r) / nullif(power(avg(power(greatest(-r, 0), 3)), 1e0 / 3), 0)
downside_potential: avg(greatest(-r, 0))
upside_potential: avg(greatest(r, 0))
omega_sharpe_ratio[threshold=0e0]: (avg(r) - {{threshold}}) / nullif(avg(greatest({{threshold}} - r, 0)), 0)
realized_variance: sum(r * r)
realized_volatility: sqrt(sum(r * r))
tail_ratio: abs(percentile(r, 0.95e0)) / nullif(abs(percentile(r, 0.05e0)), 0)
value_at_risk[level=0.95e0]: CASE WHEN {{level}} > 0.5e0 AND {{level}} < 1 THEN -percentile(r, 1 - {{level}}) END
common_sense_ratio: abs(percentile(r, 0.95e0)) / nullif(abs(percentile(r, 0.05e0)), 0) * sum(r) FILTER (WHERE r > 0) / nullif(abs(sum(r) FILTER (WHERE r < 0)), 0)
reward_to_var_ratio[level=0.95e0]: CASE WHEN percentile(r, 1 - {{level}}) < 0 THEN avg(r) / -percentile(r, 1 - {{level}}) END
parametric_var[level=0.95e0] -> gaussian_var: avg(r) ;; stddev_samp(r) ;; {{level}}
parametric_es[level=0.95e0] -> gaussian_es: avg(r) ;; stddev_samp(r) ;; {{level}}
""")

define("quant", "return=r", """
cvar[level=0.95e0]: -avg(r) FILTER (WHERE r <= lo)
starr_ratio[level=0.95e0]: CASE WHEN avg(r) FILTER (WHERE r <= lo) < 0 THEN avg(r) / -(avg(r) FILTER (WHERE r <= lo)) END
rachev_ratio[level=0.95e0]: avg(r) FILTER (WHERE r >= hi) / nullif(-(avg(r) FILTER (WHERE r <= lo)), 0)
""", totals="percentile(r, 1 - {level}) AS lo, percentile(r, {level}) AS hi")

# central moments of the returns
with_totals("avg(r) AS mu, stddev_samp(r) AS sd", name="centred")
MOMENTS = "avg(power(r - mu, 3)) / nullif(power(avg(power(r - mu, 2)), 1.5e0), 0)", "avg(power(r - mu, 4)) / nullif(power(avg(power(r - mu, 2)), 2), 0) - 3"
SR = "min(mu) / nullif(min(sd), 0)"
define("quant", "return=r", f"""
adjusted_sharpe_ratio: CASE WHEN count(*) >= 4 THEN {SR} * (1 + {MOMENTS[0]} / 6 * {SR} - ({MOMENTS[1]}) / 24 * power({SR}, 2)) END
bias_ratio: count_if(r >= 0 AND r <= sd) / nullif(count_if(r < 0 AND r >= -sd), 0)
probabilistic_sharpe_ratio -> psr: {SR} ;; count(*) ;; {MOMENTS[0]} ;; {MOMENTS[1]} ;; 0e0
deflated_sharpe[trials=10,var_sr=0.01e0] -> deflated: {SR} ;; count(*) ;; {MOMENTS[0]} ;; {MOMENTS[1]} ;; {{trials}} ;; {{var_sr}}
cornish_fisher_var[level=0.95e0] -> cornish_fisher: min(mu) ;; min(sd) ;; {MOMENTS[0]} ;; {MOMENTS[1]} ;; {{level}} ;; count(*)
modified_sharpe_ratio[level=0.95e0] -> modified_sharpe: min(mu) ;; min(sd) ;; {MOMENTS[0]} ;; {MOMENTS[1]} ;; {{level}} ;; count(*)
""", source="{centred}")

define("quant", "return=r", f"""
max_drawdown: min(dd)
calmar[P=252]: CASE WHEN count(*) > 1 AND min(dd) < 0 THEN {ANN} / abs(min(dd)) END
ulcer_index: sqrt(avg(dd * dd))
pain_index: avg(abs(dd))
martin_ratio[P=252]: CASE WHEN count(*) > 1 THEN {ANN} / nullif(sqrt(avg(dd * dd)), 0) END
recovery_factor: ({GROWTH} - 1) / nullif(abs(min(dd)), 0)
pain_ratio[P=252]: CASE WHEN count(*) > 1 THEN {ANN} / nullif(avg(abs(dd)), 0) END
sterling_ratio[P=252]: CASE WHEN count(*) > 1 THEN {ANN} / (abs(min(dd)) + 0.1e0) END
burke_ratio[P=252]: CASE WHEN count(*) > 1 THEN {ANN} / nullif(sqrt(sum(dd * dd)), 0) END
time_underwater: avg(CASE WHEN dd < 0 THEN 1e0 ELSE 0e0 END)
drawdown_deviation: stddev_samp(dd)
drawdown_at_risk[level=0.95e0]: -percentile(dd, 1 - {{level}})
""", source="{drawdown}", ordered=True)

define("quant", "return=r", "cdar[level=0.95e0]: -avg(dd) FILTER (WHERE dd <= cut)", source="{drawdown}", totals="percentile(dd, 1 - {level}) AS cut", ordered=True)

running("under_water", "{drawdown}", "pos, dd", run="sum(CASE WHEN dd < 0 THEN 0 ELSE 1 END)")
source("under_runs", "SELECT g, run, count_if(dd < 0) AS len FROM {under_water} q3 GROUP BY g, run")
define("quant", "return=r", "max_drawdown_duration: max(len)", source="{under_runs}", ordered=True)
running("losing", "{t}", "pos, r", run="sum(CASE WHEN r < 0 THEN 0 ELSE 1 END)")
source("loss_runs", "SELECT g, run, count_if(r < 0) AS len FROM {losing} q3 GROUP BY g, run")
define("quant", "return=r", "max_consecutive_losses: max(len)", source="{loss_runs}", ordered=True)

nearby("lagged_r", "{t}", "pos, r, lag(r) OVER ({W}) AS r1", before=1)
define("quant", "return=r", """
bipower_variation: CASE WHEN count(*) > 1 THEN acos(-1e0) / 2 * sum(abs(r) * abs(r1)) END
jump_variation: CASE WHEN count(*) > 1 THEN greatest(sum(r * r) - acos(-1e0) / 2 * sum(abs(r) * abs(r1)), 0) END
""", source="{lagged_r}", ordered=True)

nearby("q_sums", "{t}", "pos, r, sum(r) OVER ({W} ROWS BETWEEN {q} - 1 PRECEDING AND CURRENT ROW) AS s, row_number() OVER ({W}) AS rn", before="{q} - 1")
define("quant", "return=r", """
variance_ratio[q=2]: CASE WHEN {q} >= 2 AND count(*) > {q} THEN
  sum(power(s - {q} * mu, 2)) FILTER (WHERE rn >= {q}) / nullif({q} * (count(*) - {q} + 1) * (1 - {q} / (count(*) * 1e0)), 0) / nullif(sum(power(r - mu, 2)) / (count(*) - 1), 0) END
""", source="{q_sums}", totals="avg(r) AS mu", ordered=True)

VB = "nullif(var_samp(b), 0)"
BETA = f"(covar_samp(r, b) / {VB})"
ALPHA = f"(avg(r) - {BETA} * avg(b))"
SSR = f"(CASE WHEN var_samp(b) > 0 THEN greatest((count(*) - 1) * (var_samp(r) - power(covar_samp(r, b), 2) / {VB}), 0) END)"
define("quant", "return=r, benchmark=b", f"""
beta: {BETA}
alpha[P=252]: {ALPHA} * {{P}}
information_ratio[P=252]: avg(r - b) / nullif(stddev_samp(r - b), 0) * sqrt({{P}})
tracking_error[P=252]: stddev_samp(r - b) * sqrt({{P}})
up_capture_ratio: avg(r) FILTER (WHERE b > 0) / nullif(avg(b) FILTER (WHERE b > 0), 0)
down_capture_ratio: avg(r) FILTER (WHERE b < 0) / nullif(avg(b) FILTER (WHERE b < 0), 0)
capture_ratio: (avg(r) FILTER (WHERE b > 0) / nullif(avg(b) FILTER (WHERE b > 0), 0)) / nullif(avg(r) FILTER (WHERE b < 0) / nullif(avg(b) FILTER (WHERE b < 0), 0), 0)
treynor_ratio[P=252]: avg(r) * {{P}} / nullif({BETA}, 0)
r_squared: power(covar_pop(r, b) / nullif(stddev_pop(r) * stddev_pop(b), 0), 2)
active_return[P=252]: avg(r - b) * {{P}}
m2_measure: avg(r) / nullif(stddev_samp(r), 0) * stddev_samp(b)
appraisal_ratio: {ALPHA} / nullif(sqrt({SSR} / (count(*) - 1)), 0)
batting_average: avg(CASE WHEN r > b THEN 1e0 ELSE 0e0 END)
idiosyncratic_volatility: CASE WHEN count(*) > 2 THEN sqrt({SSR} / (count(*) - 2)) END
alpha_tstat: CASE WHEN count(*) > 2 THEN {ALPHA} / nullif(sqrt({SSR} / (count(*) - 2)) * sqrt(1e0 / count(*) + power(avg(b), 2) / nullif((count(*) - 1) * var_samp(b), 0)), 0) END
beta_tstat: CASE WHEN count(*) > 2 THEN {BETA} / nullif(sqrt({SSR} / (count(*) - 2)) / nullif(sqrt((count(*) - 1) * var_samp(b)), 0), 0) END
bull_beta: covar_samp(r, b) FILTER (WHERE b > 0) / nullif(var_samp(b) FILTER (WHERE b > 0), 0)
bear_beta: covar_samp(r, b) FILTER (WHERE b < 0) / nullif(var_samp(b) FILTER (WHERE b < 0), 0)
up_down_beta_ratio: (covar_samp(r, b) FILTER (WHERE b > 0) / nullif(var_samp(b) FILTER (WHERE b > 0), 0)) / nullif(covar_samp(r, b) FILTER (WHERE b < 0) / nullif(var_samp(b) FILTER (WHERE b < 0), 0), 0)
""")

define("quant", "return=r, var=v", """
var_breach_rate: avg(CASE WHEN -r > v THEN 1e0 ELSE 0e0 END)
realized_shortfall: avg(-r) FILTER (WHERE -r > v)
expected_exceedance: avg(-r - v) FILTER (WHERE -r > v)
basel_traffic_light: CASE WHEN count_if(-r > v) <= 4 THEN 0e0 WHEN count_if(-r > v) = 5 THEN 0.4e0 WHEN count_if(-r > v) = 6 THEN 0.5e0
  WHEN count_if(-r > v) = 7 THEN 0.65e0 WHEN count_if(-r > v) = 8 THEN 0.75e0 WHEN count_if(-r > v) = 9 THEN 0.85e0 ELSE 1e0 END
""")
define("quant", "return=r, var=v, es=es", """
es_backtest_ratio: sum(-r) FILTER (WHERE -r > v) / nullif(sum(es) FILTER (WHERE -r > v), 0)
acerbi_szekely_z1[level=0.975e0]: CASE WHEN count_if(-r > v AND es <= 0) = 0 THEN avg(-r / nullif(es, 0)) FILTER (WHERE -r > v) - 1 END
acerbi_szekely_z2[level=0.975e0]: CASE WHEN count_if(-r > v AND es <= 0) = 0 THEN coalesce(sum(-r / nullif(es, 0)) FILTER (WHERE -r > v), 0) / (count(*) * (1 - {level})) - 1 END
""")

define("quant", "flag=flag", """
kupiec_pof[p0=0.01e0] -> kupiec: count(*) ;; count_if(flag <> 0) ;; {p0}
""")
nearby("flag_moves", "{t}", "pos, CASE WHEN flag <> 0 THEN 1 ELSE 0 END AS f, lag(CASE WHEN flag <> 0 THEN 1 ELSE 0 END) OVER ({W}) AS f1", before=1)
define("quant", "flag=flag", """
christoffersen_independence -> markov: count_if(f1 = 0 AND f = 0) ;; count_if(f1 = 0 AND f = 1) ;; count_if(f1 = 1 AND f = 0) ;; count_if(f1 = 1 AND f = 1)
christoffersen_cc[p0=0.01e0] -> coverage: count_if(f1 = 0 AND f = 0) ;; count_if(f1 = 0 AND f = 1) ;; count_if(f1 = 1 AND f = 0) ;; count_if(f1 = 1 AND f = 1) ;; count(*) ;; count_if(f = 1) ;; {p0}
""", source="{flag_moves}", ordered=True)

# a price of zero or less has no logarithm: no value for the key
define("quant", "high=h, low=l", "parkinson_volatility: CASE WHEN min(least(h, l)) > 0 THEN sqrt(avg(power(ln(h / l), 2)) / (4 * ln(2e0))) END")
PRICED = "min(least(o, h, l, c)) > 0"
define("quant", "open=o, high=h, low=l, close=c", f"""
garman_klass_volatility: CASE WHEN {PRICED} THEN sqrt(avg(0.5e0 * power(ln(h / l), 2) - (2 * ln(2e0) - 1) * power(ln(c / o), 2))) END
rogers_satchell_volatility: CASE WHEN {PRICED} THEN sqrt(avg(ln(h / c) * ln(h / o) + ln(l / c) * ln(l / o))) END
""")
nearby("bars", "{t}", "pos, o, h, l, c, lag(c) OVER ({W}) AS c1", before=1)
K = "(0.34e0 / (1.34e0 + (count(c1) + 1e0) / nullif(count(c1) - 1, 0)))"
define("quant", "open=o, high=h, low=l, close=c", f"""
yang_zhang_volatility: CASE WHEN count(c1) >= 2 AND {PRICED} THEN sqrt(var_samp(ln(o / c1)) + {K} * var_samp(ln(c / o)) FILTER (WHERE c1 IS NOT NULL) + (1 - {K}) * avg(ln(h / c) * ln(h / o) + ln(l / c) * ln(l / o)) FILTER (WHERE c1 IS NOT NULL)) END
""", source="{bars}", ordered=True)

# the largest 4 k + 1 values, with the key's size and least value
source("desc_x", "SELECT z.g, z.x, z.rn, m.n, m.least FROM (SELECT g, x, rn FROM (SELECT g, x, row_number() OVER (PARTITION BY g ORDER BY x DESC) AS rn FROM {t} q0) q1 WHERE rn <= 4 * {k} + 1) z "
       "JOIN (SELECT g, count(*) AS n, min(x) AS least FROM {t} q2 GROUP BY g) m ON z.g = m.g")
define("quant", "value=x", """
hill_estimator[k=25]: CASE WHEN min(least) > 0 AND min(n) > {k} AND sum(ln(x)) FILTER (WHERE rn <= {k}) / {k} - ln(max(x) FILTER (WHERE rn = {k} + 1)) > 1e-14 THEN 1 / (sum(ln(x)) FILTER (WHERE rn <= {k}) / {k} - ln(max(x) FILTER (WHERE rn = {k} + 1))) END
pickands_estimator[k=25]: CASE WHEN min(n) >= 4 * {k} AND max(x) FILTER (WHERE rn = {k}) > max(x) FILTER (WHERE rn = 2 * {k}) AND max(x) FILTER (WHERE rn = 2 * {k}) > max(x) FILTER (WHERE rn = 4 * {k}) THEN
  ln((max(x) FILTER (WHERE rn = {k}) - max(x) FILTER (WHERE rn = 2 * {k})) / (max(x) FILTER (WHERE rn = 2 * {k}) - max(x) FILTER (WHERE rn = 4 * {k}))) / ln(2e0) END
""", source="{desc_x}")
define("quant", "value=x", "max_to_sum_ratio[p=2e0]: max(power(abs(x), {p})) / nullif(sum(power(abs(x), {p})), 0)")

# rescaled range of the whole series and of dyadic windows
with_totals("avg(x) AS mu, stddev_pop(x) AS sd", name="centred_x")
running("walk", "{centred_x}", "pos, sd", s="sum(x - mu)")
define("quant", "value=x", "rescaled_range: (greatest(max(s), 0) - least(min(s), 0)) / nullif(min(sd), 0)", source="{walk}", ordered=True)
source("numbered", f"SELECT g, x, row_number() OVER ({W}) - 1 AS k, count(*) OVER (PARTITION BY g) AS n FROM {{t}} q0",
       "SELECT z.g, z.x, z.nth AS k, m.n FROM {t} z JOIN (SELECT g, count(*) AS n FROM {t} k0 GROUP BY g) m ON z.g = m.g")
running("sums", "{t}", "pos, x", upto="sum(x)")
source("sizes", " UNION ALL ".join(f"SELECT {8 << j} AS w" for j in range(24)))
source("windows", "SELECT g, w, k, x, CAST(floor(k / (w * 1e0)) AS BIGINT) AS b FROM {numbered} q1 JOIN {sizes} q2 ON q2.w <= q1.n / 2 WHERE q1.k < floor(q1.n / (q2.w * 1e0)) * q2.w")
source("window_means", "SELECT g, w, b, avg(x) AS mu, stddev_pop(x) AS sd FROM {windows} q3 GROUP BY g, w, b")
source("window_walks", "SELECT z.g, z.w, z.b, m.sd, sum(z.x - m.mu) OVER (PARTITION BY z.g, z.w, z.b ORDER BY z.k ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS s "
       "FROM {windows} z JOIN {window_means} m ON z.g = m.g AND z.w = m.w AND z.b = m.b",
       # in blocks: the sum up to here less that up to the window, which is the one at the last row before it
       "SELECT z.g, z.w, z.b, m.sd, u.upto - coalesce(v.upto, 0) - (z.k - z.b * z.w + 1) * m.mu AS s FROM {windows} z JOIN {window_means} m ON z.g = m.g AND z.w = m.w AND z.b = m.b "
       "JOIN {sums} u ON z.g = u.g AND z.k = u.nth LEFT JOIN {sums} v ON z.g = v.g AND z.b * z.w - 1 = v.nth")
source("window_rs", "SELECT g, w, avg(rs) AS rs FROM (SELECT g, w, b, (greatest(max(s), 0) - least(min(s), 0)) / nullif(min(sd), 0) AS rs FROM {window_walks} q4 GROUP BY g, w, b) q5 GROUP BY g, w")
define("quant", "value=x", "hurst_rs: CASE WHEN count(rs) >= 2 THEN covar_pop(ln(rs), ln(w * 1e0)) / nullif(var_pop(ln(w * 1e0)), 0) END", source="(SELECT * FROM {window_rs} q6 WHERE rs > 0)", ordered=True, solver="hurst")
