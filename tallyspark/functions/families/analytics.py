"""Column statistics, inequality, diversity, distances; operations metrics."""

from ..recipes import define, nearby, source

POS = "min(x) > 0"
Q = lambda q: f"percentile(x, {q})"

define("analytics", "value=x", f"""
column_sum: sum(x)
column_mean: avg(x)
column_median: {Q("0.5e0")}
percentile[q=0.5e0]: {Q("{q}")}
column_min: min(x)
column_max: max(x)
column_std[ddof=1]: CASE WHEN {{ddof}} = 1 THEN stddev_samp(x) ELSE stddev_pop(x) END
iqr: {Q("0.75e0")} - {Q("0.25e0")}
hhi: CASE WHEN min(x) >= 0 THEN sum(x * x) / nullif(power(sum(x), 2), 0) END
variance: var_samp(x)
range_value: max(x) - min(x)
geometric_mean: CASE WHEN {POS} THEN exp(avg(ln(x))) END
harmonic_mean: CASE WHEN {POS} THEN count(*) / sum(1 / nullif(x, 0)) END
atkinson_index: CASE WHEN {POS} THEN 1 - exp(avg(ln(x))) / avg(x) END
quartile_coefficient_dispersion: ({Q("0.75e0")} - {Q("0.25e0")}) / nullif({Q("0.75e0")} + {Q("0.25e0")}, 0)
index_of_dispersion: var_samp(x) / nullif(avg(x), 0)
percentile_ratio: CASE WHEN {POS} THEN {Q("0.9e0")} / nullif({Q("0.1e0")}, 0) END
mean_log_deviation: CASE WHEN {POS} THEN ln(avg(x)) - avg(ln(x)) END
pearson_median_skewness: 3 * (avg(x) - {Q("0.5e0")}) / nullif(stddev_samp(x), 0)
studentized_range: (max(x) - min(x)) / nullif(stddev_samp(x), 0)
midhinge: ({Q("0.25e0")} + {Q("0.75e0")}) / 2
trimean: 0.25e0 * {Q("0.25e0")} + 0.5e0 * {Q("0.5e0")} + 0.25e0 * {Q("0.75e0")}
gastwirth_location: 0.3e0 * {Q("1e0 / 3")} + 0.4e0 * {Q("0.5e0")} + 0.3e0 * {Q("2e0 / 3")}
power_mean[p=2e0]: CASE WHEN {POS} AND {{p}} <> 0 THEN power(avg(power(x, {{p}})), 1 / {{p}}) END
lehmer_mean[p=2e0]: CASE WHEN {POS} THEN sum(power(x, {{p}})) / nullif(sum(power(x, {{p}} - 1)), 0) END
geometric_std: CASE WHEN {POS} THEN exp(stddev_samp(ln(x))) END
root_mean_square: sqrt(avg(x * x))
margalef_richness: CASE WHEN min(x) >= 0 AND sum(x) > 1 THEN (count_if(x > 0) - 1) / ln(sum(x)) END
menhinick_richness: CASE WHEN min(x) >= 0 THEN count_if(x > 0) / sqrt(nullif(sum(x), 0)) END
mcintosh_diversity: CASE WHEN min(x) >= 0 THEN (sum(x) - sqrt(sum(x * x))) / nullif(sum(x) - sqrt(sum(x)), 0) END
""")
define("analytics", "", "row_count: count(*)")
define("analytics", "value=x", """
mean_abs_deviation: avg(abs(x - mu))
theil_index: CASE WHEN min(x) > 0 THEN avg(x / mu * ln(x / mu)) END
hoover_index: CASE WHEN min(x) > 0 THEN 0.5e0 * sum(abs(x / s - 1e0 / n)) END
generalized_entropy_index[alpha=2e0]: CASE WHEN min(x) <= 0 THEN NULL WHEN {alpha} = 0 THEN avg(ln(mu / x)) WHEN {alpha} = 1 THEN avg(x / mu * ln(x / mu))
  ELSE (avg(power(x / mu, {alpha})) - 1) / nullif({alpha} * ({alpha} - 1), 0) END
relative_mean_deviation: avg(abs(x - mu)) / nullif(abs(min(mu)), 0)
""", totals="avg(x) AS mu, sum(x) AS s, count(*) AS n")
define("analytics", "value=x", """
median_abs_deviation: median(abs(x - med))
outlier_count[k=1.5e0]: count_if(x < q1 - {k} * (q3 - q1) OR x > q3 + {k} * (q3 - q1))
""", totals="median(x) AS med, percentile(x, 0.25e0) AS q1, percentile(x, 0.75e0) AS q3")

# shares of the total, for non-negative amounts
source("shares", "SELECT z.g, z.x, z.x / nullif(m.s, 0) AS w, CASE WHEN m.low >= 0 AND m.s > 0 THEN 1 END AS ok FROM {t} z JOIN (SELECT g, sum(x) AS s, min(x) AS low FROM {t} k GROUP BY g) m ON z.g = m.g")
H = "(-sum(w * ln(nullif(w, 0))))"
OK = "CASE WHEN count(ok) = count(*) THEN {} END".format
define("analytics", "value=x", f"""
shannon_diversity: {OK(H)}
pielou_evenness: {OK(f"{H} / nullif(ln(count_if(w > 0) * 1e0), 0)")}
berger_parker: {OK("max(w)")}
normalized_hhi: {OK("(sum(w * w) - 1e0 / count(*)) / nullif(1 - 1e0 / count(*), 0)")}
hill_number[q=1e0]: {OK(f"CASE WHEN {{q}} = 1 THEN exp({H}) ELSE power(sum(power(w, {{q}})) FILTER (WHERE w > 0), 1 / nullif(1 - {{q}}, 0)) END")}
renyi_entropy[q=2e0]: {OK(f"CASE WHEN {{q}} = 1 THEN {H} ELSE ln(sum(power(w, {{q}})) FILTER (WHERE w > 0)) / nullif(1 - {{q}}, 0) END")}
tsallis_entropy[q=2e0]: {OK(f"CASE WHEN {{q}} = 1 THEN {H} ELSE (1 - sum(power(w, {{q}})) FILTER (WHERE w > 0)) / nullif({{q}} - 1, 0) END")}
simpson_evenness: {OK("1 / nullif(sum(w * w), 0) / nullif(count_if(w > 0), 0)")}
""", source="{shares}")
# for long keys, places come from a sort in ranges
BY_X = (("nx", "x"),)
source("big_shares", "SELECT g, x, w, ok, row_number() OVER (PARTITION BY g ORDER BY w DESC) AS rn FROM {shares} s1",
       "SELECT z.g, z.x, z.x / nullif(m.s, 0) AS w, CASE WHEN m.low >= 0 AND m.s > 0 THEN 1 END AS ok, m.n - z.nx AS rn FROM {t} z JOIN (SELECT g, sum(x) AS s, min(x) AS low, count(*) AS n FROM {t} k GROUP BY g) m ON z.g = m.g")
define("analytics", "value=x", f"""
concentration_ratio[k=4]: {OK("sum(w) FILTER (WHERE rn <= {k})")}
rosenbluth_index: {OK("1 / nullif(2 * sum(rn * w) - 1, 0)")}
comprehensive_concentration_index: {OK("max(w) + sum(w * w * (2 - w)) FILTER (WHERE rn > 1)")}
""", source="{big_shares}", places=BY_X)

# order statistics
source("sorted_x", "SELECT g, x, row_number() OVER (PARTITION BY g ORDER BY x) AS rn, count(*) OVER (PARTITION BY g) AS n FROM {t} o0",
       "SELECT z.g, z.x, z.nx + 1 AS rn, m.n FROM {t} z JOIN (SELECT g, count(*) AS n FROM {t} k GROUP BY g) m ON z.g = m.g")
GINI = "(sum((2 * rn - n - 1) * x) / nullif(min(n) * sum(x), 0))"
GMD = "(2 * sum((2 * rn - n - 1) * x) / nullif(min(n) * (min(n) - 1e0), 0))"
B1 = "(sum((rn - 1) / nullif(n - 1e0, 0) * x) / min(n))"
define("analytics", "value=x", f"""
gini_coefficient: CASE WHEN min(x) >= 0 THEN {GINI} END
sen_welfare: CASE WHEN min(x) >= 0 THEN avg(x) * (1 - {GINI}) END
gini_mean_difference: {GMD}
relative_mean_difference: {GMD} / nullif(abs(avg(x)), 0)
l_scale: CASE WHEN min(n) >= 4 THEN 2 * {B1} - avg(x) END
l_cv: CASE WHEN min(n) >= 4 THEN (2 * {B1} - avg(x)) / nullif(avg(x), 0) END
trimmed_mean[proportion=0.1e0]: CASE WHEN {{proportion}} >= 0 AND {{proportion}} < 0.5e0 THEN avg(x) FILTER (WHERE rn > floor({{proportion}} * n) AND rn <= n - floor({{proportion}} * n)) END
trimmed_std[trim=0.1e0]: stddev_samp(x) FILTER (WHERE rn > floor({{trim}} * n) AND rn <= n - floor({{trim}} * n))
""", source="{sorted_x}", places=BY_X)
define("analytics", "value=x", """
winsorized_mean[trim=0.1e0]: avg(least(greatest(x, low), high))
winsorized_std[trim=0.1e0]: stddev_samp(least(greatest(x, low), high))
""", source="{sorted_x}", places=BY_X, totals="max(CASE WHEN rn = floor({trim} * n) + 1 THEN x END) AS low, max(CASE WHEN rn = n - floor({trim} * n) THEN x END) AS high")
# means of all pairs of values, by distinct values with their numbers of pairs
source("tallied", "SELECT g, x, count(*) * 1e0 AS c FROM {t} o0 GROUP BY g, x")
source("walsh", "SELECT i.g, (i.x + j.x) / 2e0 AS v, sum(CASE WHEN i.x = j.x THEN i.c * (i.c + 1) / 2 ELSE i.c * j.c END) AS w FROM {tallied} i JOIN {tallied} j ON i.g = j.g AND i.x <= j.x GROUP BY i.g, (i.x + j.x) / 2e0")
source("walsh_upto", "SELECT z.g, z.v, sum(z.w) OVER (PARTITION BY z.g ORDER BY z.v ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto, m.total FROM {walsh} z JOIN (SELECT g, sum(w) AS total FROM {walsh} k GROUP BY g) m ON z.g = m.g")
define("analytics", "value=x", "hodges_lehmann_estimator: (min(CASE WHEN upto >= floor((total + 1) / 2) THEN v END) + min(CASE WHEN upto >= floor(total / 2) + 1 THEN v END)) / 2", source="{walsh_upto}")

# text cells
BLANK = "lower(trim(coalesce(s, ''))) IN ('', 'nan', 'na', 'null', 'none')"
define("analytics", "value=s'", f"""
distinct_count[mode=drop_null]: CASE WHEN '{{mode}}' = 'include_null' THEN count(DISTINCT trim(coalesce(s, ''))) ELSE count(DISTINCT CASE WHEN NOT {BLANK} THEN trim(s) END) END
null_fraction: avg(CASE WHEN {BLANK} THEN 1e0 ELSE 0e0 END)
duplicate_count: count(*) - count(DISTINCT trim(coalesce(s, '')))
uniqueness_ratio: count(DISTINCT trim(coalesce(s, ''))) / count(*)
""")
source("cells", "SELECT g, trim(coalesce(s, '')) AS s, count(*) AS n FROM {t} a0 GROUP BY g, trim(coalesce(s, ''))")
define("analytics", "value=s'", """
mode_share: max(n) / sum(n)
entropy[mode=bits]: (ln(sum(n) * 1e0) - sum(n * ln(n * 1e0)) / sum(n)) / CASE WHEN '{mode}' = 'nats' THEN 1e0 ELSE ln(2e0) END
""", source="{cells}")
define("analytics", "group=s', value=x", "groupby_aggregate[label=none,mode=sum]: max(CASE WHEN s = '{label}' THEN CASE WHEN '{mode}' = 'mean' THEN m ELSE t END END)", source="(SELECT g, trim(s) AS s, sum(x) AS t, avg(x) AS m FROM {t} a0 GROUP BY g, trim(s))")
define("analytics", "left_key=lk', joined_key=jk'", "join_row_loss: count(lk) - count(jk)")
define("analytics", "flag=flag", "ratio_share: avg(CASE WHEN flag <> 0 THEN 1e0 ELSE 0e0 END)")
define("analytics", "value=x, weight=w", "weighted_mean: sum(w * x) / nullif(sum(w), 0)")
define("analytics", "expected=dp, actual=dq", "psi: CASE WHEN min(dp) > 0 AND min(dq) > 0 THEN sum((dq / sq - dp / sp) * ln(dq / sq / (dp / sp))) END", totals="sum(dp) AS sp, sum(dq) AS sq")
nearby("steps", "{t}", "pos, x, lag(x) OVER ({W}) AS x1", before=1)
define("analytics", "value=x", "growth_rate[mode=period]: CASE WHEN count(*) > 1 THEN max_by(x, pos) / nullif(CASE WHEN '{mode}' = 'total' THEN min_by(x, pos) ELSE max_by(x1, pos) END, 0) - 1 END", source="{steps}", ordered=True)

# distances
D = "(x - y)"
TT, TF, FT, FF = (f"count_if({a} AND {b})" for a, b in (("x <> 0", "y <> 0"), ("x <> 0", "y = 0"), ("x = 0", "y <> 0"), ("x = 0", "y = 0")))
define("analytics", "x=x, y=y", f"""
covariance: covar_samp(x, y)
euclidean_distance: sqrt(sum({D} * {D}))
squared_euclidean_distance: sum({D} * {D})
manhattan_distance: sum(abs({D}))
chebyshev_distance: max(abs({D}))
cosine_distance: 1 - sum(x * y) / nullif(sqrt(sum(x * x)) * sqrt(sum(y * y)), 0)
braycurtis_distance: sum(abs({D})) / nullif(sum(abs(x + y)), 0)
canberra_distance: coalesce(sum(abs({D}) / nullif(abs(x) + abs(y), 0)), 0)
correlation_distance: 1 - covar_pop(x, y) / nullif(stddev_pop(x) * stddev_pop(y), 0)
minkowski_distance[p=2e0]: CASE WHEN {{p}} >= 1 THEN power(sum(power(abs({D}), {{p}})), 1 / {{p}}) END
hamming_distance: avg(CASE WHEN x <> y THEN 1e0 ELSE 0e0 END)
dice_distance: ({TF} + {FT}) / nullif(2 * {TT} + {TF} + {FT}, 0)
rogers_tanimoto_distance: 2 * ({TF} + {FT}) / nullif(count(*) + {TF} + {FT}, 0)
russell_rao_distance: (count(*) - {TT}) / count(*)
sokal_sneath_distance: 2 * ({TF} + {FT}) / nullif({TT} + 2 * ({TF} + {FT}), 0)
yule_distance: CASE WHEN {TF} * {FT} = 0 THEN 0e0 ELSE 2e0 * {TF} * {FT} / ({TT} * {FF} + {TF} * {FT}) END
""")

# --- operations -----------------------------------------------------------------
P = lambda q: f"percentile(d, {q})"
define("engineering", "duration=d", f"""
latency_p50: {P("0.5e0")}
latency_p75: {P("0.75e0")}
latency_p90: {P("0.9e0")}
latency_p95: {P("0.95e0")}
latency_p99: {P("0.99e0")}
latency_p999: {P("0.999e0")}
tail_latency_ratio: {P("0.99e0")} / nullif({P("0.5e0")}, 0)
latency_stddev: stddev_samp(d)
throughput: count(*) / nullif(sum(d), 0)
apdex[t=1e0]: (count_if(d <= {{t_}}) + count_if(d > {{t_}} AND d <= 4 * {{t_}}) / 2e0) / count(*)
slo_attainment[threshold=0e0]: avg(CASE WHEN d <= {{threshold}} THEN 1e0 ELSE 0e0 END)
""".replace("[t=1e0]", "[t_=1e0]"))
nearby("waits", "{t}", "pos, d, lag(d) OVER ({W}) AS d1", before=1)
define("engineering", "duration=d", "jitter: avg(abs(d - d1))", source="{waits}", ordered=True)
define("engineering", "value=x", "peak_memory: max(x)")
define("engineering", "hits=hits", "test_coverage: avg(CASE WHEN hits > 0 THEN 1e0 ELSE 0e0 END)")
SHARE = "avg(CASE WHEN flag <> 0 THEN 1e0 ELSE 0e0 END)"
define("engineering", "flag=flag", f"""
error_rate[mode=flag]: CASE WHEN '{{mode}}' = 'http4xx' THEN avg(CASE WHEN flag >= 400 THEN 1e0 ELSE 0e0 END) WHEN '{{mode}}' = 'http5xx' THEN avg(CASE WHEN flag >= 500 THEN 1e0 ELSE 0e0 END) ELSE {SHARE} END
uptime_pct: {SHARE}
cache_hit_rate: {SHARE}
error_budget_burn[target=0.01e0]: {SHARE} / nullif({{target}}, 0)
mtbf: count(*) / nullif(count_if(flag <> 0), 0)
""")
for name, tags, expr in (
    ("compression_ratio", "original, compressed", "sum(original) / nullif(sum(compressed), 0)"),
    ("availability", "uptime, downtime", "sum(uptime) / nullif(sum(uptime) + sum(downtime), 0)"),
    ("failure_rate", "failures, operating_time", "sum(failures) / nullif(sum(operating_time), 0)"),
    ("mean_time_to_repair", "downtime, repairs", "sum(downtime) / nullif(sum(repairs), 0)"),
    ("mean_time_to_failure", "uptime, failures", "sum(uptime) / nullif(sum(failures), 0)"),
    ("defect_density", "defects, size", "sum(defects) / nullif(sum(size), 0)"),
    ("dpmo", "defects, opportunities", "sum(defects) / nullif(sum(opportunities), 0) * 1e6"),
    ("first_pass_yield", "passed, total", "sum(passed) / nullif(sum(total), 0)"),
    ("rolled_throughput_yield", "yield_step", "CASE WHEN min(yield_step) <= 0 THEN 0e0 ELSE exp(sum(ln(yield_step))) END"),
):
    define("engineering", tags, f"{name}: {expr}")
SIDE = lambda f, s: f"({f}(v) FILTER (WHERE side = '{s}'))"
define("engineering", "before=v, after=side'", f"""
speedup_ratio[mode=mean]: CASE WHEN '{{mode}}' = 'median' THEN {SIDE("median", "a")} / nullif({SIDE("median", "b")}, 0) ELSE {SIDE("avg", "a")} / nullif({SIDE("avg", "b")}, 0) END
""")
