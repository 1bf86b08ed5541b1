"""Tests, associations, effect sizes, survival, series and information measures."""

from ..recipes import define, source, with_totals
from .orders import EVENT_PLACES, IN_PLACE
from .tables import HA, HAB, HB, MI, contingency, midranks

W = "PARTITION BY g ORDER BY pos"
CUM = f"{W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
TWO = "sample_a=v, sample_b=side'"


def of(f: str, side: str, c: str = "v") -> str:
    return f"({f}({c}) FILTER (WHERE side = '{side}'))"


NA, NB, MA, MB = of("count", "a"), of("count", "b"), of("avg", "a"), of("avg", "b")
VA, VB = of("var_samp", "a"), of("var_samp", "b")
POOLED = f"((({NA} - 1) * {VA} + ({NB} - 1) * {VB}) / nullif({NA} + {NB} - 2, 0))"
define("stats", TWO, f"""
lift[mode=relative]: CASE WHEN '{{mode}}' = 'absolute' THEN {MB} - {MA} ELSE ({MB} - {MA}) / nullif({MA}, 0) END
glass_delta: ({MA} - {MB}) / nullif(sqrt({VB}), 0)
cohens_h: CASE WHEN {MA} BETWEEN 0 AND 1 AND {MB} BETWEEN 0 AND 1 THEN 2 * asin(sqrt({MA})) - 2 * asin(sqrt({MB})) END
p_value[kind=welch] -> two_sample: {MA} ;; {MB} ;; {VA} ;; {VB} ;; {NA} ;; {NB} ;; '{{kind}}'
effect_size[kind=cohen_d] -> effect: {MA} ;; {MB} ;; {VA} ;; {VB} ;; {NA} ;; {NB} ;; '{{kind}}'
hedges_g[kind=hedges_g] -> effect: {MA} ;; {MB} ;; {VA} ;; {VB} ;; {NA} ;; {NB} ;; '{{kind}}'
proportion_z -> proportions: {MA} ;; {MB} ;; {NA} ;; {NB}
""")
define("stats", "treatment=v, control=side'", f"""
average_treatment_effect: {MA} - {MB}
risk_difference: {MA} - {MB}
relative_risk_reduction: ({MB} - {MA}) / nullif({MB}, 0)
number_needed_to_treat: 1 / nullif(abs({MA} - {MB}), 0)
standardized_mean_difference: ({MA} - {MB}) / nullif(sqrt(({VA} + {VB}) / 2), 0)
""")

# ranks in the union of two samples
midranks("v", "ranked")
RA = of("sum", "a", "rk")
U = f"({RA} - {NA} * ({NA} + 1e0) / 2)"
N = "count(*)"
define("stats", TWO, f"""
cliffs_delta: 2 * {U} / nullif({NA} * 1e0 * {NB}, 0) - 1
rank_biserial: 1 - 2 * {U} / nullif({NA} * 1e0 * {NB}, 0)
common_language_effect_size: {U} / nullif({NA} * 1e0 * {NB}, 0)
ansari_bradley: {of("sum", "a", "least(rk, n1 - rk)")}
wilcoxon_rank_sum: ({RA} - {NA} * ({N} + 1e0) / 2) / nullif(sqrt({NA} * 1e0 * {NB} * ({N} + 1) / 12), 0)
mood_test: ({of("sum", "a", "power(rk - n1 / 2e0, 2)")} - {NA} * ({N} * 1e0 * {N} - 1) / 12) / nullif(sqrt({NA} * 1e0 * {NB} * ({N} + 1) * ({N} * 1e0 * {N} - 4) / 180), 0)
mann_whitney -> rank_sum_p: {U} ;; {NA} ;; {NB} ;; sum(ties * 1e0 * ties - 1)
""", source="{ranked}", totals="count(*) + 1 AS n1")
source("ranked_u", "SELECT g, side, v, rk AS ru FROM {ranked} s1")
midranks("v", "ranked_w", "g, side", "{ranked_u}")
source("bm_means", "SELECT g, avg(CASE WHEN side = 'a' THEN ru END) AS ma, avg(CASE WHEN side = 'b' THEN ru END) AS mb, count_if(side = 'a') AS na, count_if(side = 'b') AS nb FROM {ranked_u} s2 GROUP BY g")
source("bm", "SELECT z.g, z.side, m.ma, m.mb, m.na, m.nb, power(z.ru - z.rk - CASE WHEN z.side = 'a' THEN m.ma - (m.na + 1e0) / 2 ELSE m.mb - (m.nb + 1e0) / 2 END, 2) AS q FROM {ranked_w} z JOIN {bm_means} m ON z.g = m.g")
define("stats", TWO, f"""
brunner_munzel: max(na) * 1e0 * max(nb) * (max(mb) - max(ma)) / nullif((max(na) + max(nb)) * sqrt(max(na) * {of("sum", "a", "q")} / nullif(max(na) - 1, 0) + max(nb) * {of("sum", "b", "q")} / nullif(max(nb) - 1, 0)), 0)
""", source="{bm}")

# distribution functions of two samples
source("points", "SELECT g, v, count_if(side = 'a') AS a, count_if(side = 'b') AS b FROM {t} s0 GROUP BY g, v")
PW = "PARTITION BY g ORDER BY v"
source("ecdf_counts", f"SELECT g, v, sum(a) OVER ({PW} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS ca, sum(b) OVER ({PW} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cb, lead(v) OVER ({PW}) - v AS step FROM {{points}} s1")
source("ecdf", "SELECT z.g, z.v, z.step, z.ca / (m.na * 1e0) AS fa, z.cb / (m.nb * 1e0) AS fb, m.na, m.nb FROM {ecdf_counts} z JOIN (SELECT g, sum(a) AS na, sum(b) AS nb FROM {points} s2 GROUP BY g) m ON z.g = m.g")
define("stats", TWO, """
ks_2samp: max(abs(fa - fb))
wasserstein_1d: CASE WHEN min(na) > 0 AND min(nb) > 0 THEN coalesce(sum(abs(fa - fb) * step), 0) END
energy_distance: CASE WHEN min(na) > 0 AND min(nb) > 0 THEN sqrt(2 * coalesce(sum(power(fa - fb, 2) * step), 0)) END
ks_test -> ks_p: max(abs(fa - fb)) ;; max(na) ;; max(nb)
""", source="{ecdf}")
source("halves", "SELECT z.g, z.side, CASE WHEN z.v > m.med THEN 1 ELSE 0 END AS above FROM {t} z JOIN (SELECT g, percentile(v, 0.5e0) AS med FROM {t} k GROUP BY g) m ON z.g = m.g")
NX, NY = "count_if(side = 'a')", "count_if(side = 'b')"
AA, AB, AT = "count_if(side = 'a' AND above = 1)", "count_if(side = 'b' AND above = 1)", "count_if(above = 1)"
E1, E2, E3, E4 = (f"({x} * 1e0 * {y} / {N})" for x, y in ((AT, NX), (AT, NY), (f"({N} - {AT})", NX), (f"({N} - {AT})", NY)))
define("stats", TWO, f"""
mood_median_test: power(abs({AA} - {E1}) - 0.5e0, 2) / nullif({E1}, 0) + power(abs({AB} - {E2}) - 0.5e0, 2) / nullif({E2}, 0)
  + power(abs({NX} - {AA} - {E3}) - 0.5e0, 2) / nullif({E3}, 0) + power(abs({NY} - {AB} - {E4}) - 0.5e0, 2) / nullif({E4}, 0)
""", source="{halves}")

# paired samples
N10, N01 = "count_if(pa <> 0 AND pb = 0)", "count_if(pa = 0 AND pb <> 0)"
define("stats", "sample_a=pa, sample_b=pb", f"mcnemar -> chi2: power(abs({N10} - {N01}) - 1, 2) / nullif({N10} + {N01}, 0) ;; 1e0")
midranks("d", "signed", "g", "(SELECT g, abs(wa - wb) AS d, CASE WHEN wa > wb THEN 1 ELSE 0 END AS up FROM {t} s0 WHERE wa <> wb)")
define("stats", "sample_a=wa, sample_b=wb", "wilcoxon_signed_rank -> signed_rank_p: sum(CASE WHEN up = 1 THEN rk ELSE 0e0 END) ;; count(*) ;; sum(ties * 1e0 * ties - 1)", source="{signed}")

# pairs of categories
contingency("grp", "outcome", "gt", text=True)
CHI = "sum(power(n - na * 1e0 * nb / total, 2) / (na * 1e0 * nb / total))"
CHIF = f"({CHI} + min(total) - sum(na * 1e0 * nb / total))"
GO = "group=grp', outcome=outcome'"
define("stats", GO, f"""
cramers_v: sqrt(greatest({CHIF}, 0) / nullif(min(total) * (least(min(ka), min(kb)) - 1e0), 0))
tschuprow_t: sqrt(greatest({CHIF}, 0) / nullif(min(total) * sqrt((min(ka) - 1e0) * (min(kb) - 1)), 0))
pearson_contingency_coefficient: sqrt(greatest({CHIF}, 0) / nullif({CHIF} + min(total), 0))
cohens_w: sqrt(greatest({CHIF}, 0) / min(total))
g_test -> chi2: 2 * sum(n * ln(n * 1e0 * total / (na * 1e0 * nb))) ;; (min(ka) - 1e0) * (min(kb) - 1)
""", source="{gt_full}")
source("gt_yates", f"SELECT g, min(ka) AS ka, min(kb) AS kb, {CHIF} AS chi, count(*) AS cells, sum(CASE WHEN n = na * 1e0 * nb / total THEN 0e0 ELSE power(abs(n - na * 1e0 * nb / total) - 0.5e0, 2) END / (na * 1e0 * nb / total)) AS yates FROM {{gt_full}} s1 GROUP BY g")
define("stats", GO, "chi_square -> chi2: max(CASE WHEN ka = 2 AND kb = 2 AND cells = 4 THEN yates ELSE chi END) ;; max((ka - 1e0) * (kb - 1))", source="{gt_yates}")
source("gt_two", "SELECT c.g, c.n, CASE WHEN c.a = m.a1 THEN 1 ELSE 2 END AS i, CASE WHEN c.b = m.b1 THEN 1 ELSE 2 END AS j, m.ka, m.kb FROM {gt} c JOIN (SELECT g, min(a) AS a1, min(b) AS b1, count(DISTINCT a) AS ka, count(DISTINCT b) AS kb FROM {gt} s1 GROUP BY g) m ON c.g = m.g")
CELL = lambda i, j: f"coalesce(sum(n) FILTER (WHERE i = {i} AND j = {j}), 0)"
CA, CB, CC, CD = CELL(1, 1), CELL(1, 2), CELL(2, 1), CELL(2, 2)
SQUARE = "max(ka) = 2 AND max(kb) = 2"
define("stats", GO, f"""
odds_ratio[mode=sample]: CASE WHEN {SQUARE} AND '{{mode}}' = 'haldane' THEN ({CA} + 0.5e0) * ({CD} + 0.5e0) / (({CB} + 0.5e0) * ({CC} + 0.5e0)) WHEN {SQUARE} THEN {CA} * 1e0 * {CD} / nullif({CB} * 1e0 * {CC}, 0) END
relative_risk: CASE WHEN {SQUARE} THEN ({CA} / nullif({CA} + {CB}, 0)) / nullif({CC} / nullif({CC} + {CD}, 0), 0) END
fisher_exact -> fisher: {CA} ;; {CB} ;; {CC} ;; {CD}
""", source="{gt_two}")
define("stats", "group=grp'", "srm_pvalue -> chi2: sum(n * 1e0 * n) * count(*) / sum(n) - sum(n) ;; count(*) - 1e0", source="(SELECT g, trim(grp) AS grp, count(*) AS n FROM {t} s0 GROUP BY g, trim(grp))")
define("stats", "group=grp', label=y", "information_value: CASE WHEN min(tg) > 0 AND min(tb) > 0 THEN coalesce(sum(CASE WHEN good > 0 AND bad > 0 THEN (good / (tg * 1e0) - bad / (tb * 1e0)) * ln((good / (tg * 1e0)) / (bad / (tb * 1e0))) END), 0) END",
       source=with_totals("nullif(sum(good), 0) AS tg, nullif(sum(bad), 0) AS tb", "(SELECT g, trim(grp) AS grp, count_if(y = 0) AS good, count_if(y <> 0) AS bad FROM {t} s0 GROUP BY g, trim(grp))"))
contingency("cx", "cy", "xy", text=True)
define("stats", "x=cx', y=cy'", f"""
conditional_entropy: {HB} - {MI}
joint_entropy: {HAB}
variation_of_information: {HA} + {HB} - 2 * {MI}
uncertainty_coefficient: {MI} / nullif({HB}, 0)
symmetric_uncertainty: 2 * {MI} / nullif({HA} + {HB}, 0)
normalized_variation_of_information: ({HA} + {HB} - 2 * {MI}) / nullif({HAB}, 0)
""", source="{xy_full}")

# groups of values
source("buckets", "SELECT g, trim(grp) AS grp, count(*) AS n, avg(v) AS m, var_pop(v) * count(*) AS ss, var_samp(v) AS var FROM {t} s0 GROUP BY g, trim(grp)")
with_totals("sum(n * m) / sum(n) AS grand", relation="{buckets}", name="grouped")
SSB, SSW, K, NN = "sum(n * power(m - grand, 2))", "sum(ss)", "count(*)", "sum(n)"
MSW = f"({SSW} / nullif({NN} - {K}, 0))"
GV = "group=grp', value=v"
define("stats", GV, f"""
eta_squared: CASE WHEN {K} > 1 THEN {SSB} / nullif({SSB} + {SSW}, 0) END
omega_squared: CASE WHEN {K} > 1 THEN ({SSB} - ({K} - 1) * {MSW}) / nullif({SSB} + {SSW} + {MSW}, 0) END
epsilon_squared: CASE WHEN {K} > 1 THEN ({SSB} - ({K} - 1) * {MSW}) / nullif({SSB} + {SSW}, 0) END
cohens_f: CASE WHEN {K} > 1 THEN sqrt({SSB} / nullif({SSW}, 0)) END
anova -> f_tail: {SSB} / nullif({K} - 1, 0) / nullif({MSW}, 0) ;; {K} - 1e0 ;; {NN} - {K} * 1e0
bartlett -> bartlett_p: {K} ;; {NN} ;; sum((n - 1) * var) ;; sum((n - 1) * ln(var)) ;; sum(1e0 / nullif(n - 1, 0)) ;; min(var)
""", source="{grouped}")
source("spread", "SELECT z.g, trim(z.grp) AS grp, abs(z.v - m.med) AS v FROM {t} z JOIN (SELECT g, trim(grp) AS grp, percentile(v, 0.5e0) AS med FROM {t} k GROUP BY g, trim(grp)) m ON z.g = m.g AND trim(z.grp) = m.grp")
source("spread_buckets", "SELECT g, grp, count(*) AS n, avg(v) AS m, var_pop(v) * count(*) AS ss FROM {spread} s1 GROUP BY g, grp")
define("stats", GV, f"levene -> f_tail: {SSB} / nullif({K} - 1, 0) / nullif({MSW}, 0) ;; {K} - 1e0 ;; {NN} - {K} * 1e0", source=with_totals("sum(n * m) / sum(n) AS grand", "{spread_buckets}"))
midranks("v", "spread_ranks", "g", "{spread}")
source("scores", "SELECT z.g, z.grp, norm_ppf(0.5e0 + z.rk / (2e0 * (m.n + 1))) AS a FROM {spread_ranks} z JOIN (SELECT g, count(*) AS n FROM {spread} s2 GROUP BY g) m ON z.g = m.g")
source("score_sums", "SELECT z.g, z.n, z.a, m.abar, m.va FROM (SELECT g, grp, count(*) AS n, avg(a) AS a FROM {scores} s3 GROUP BY g, grp) z JOIN (SELECT g, avg(a) AS abar, var_samp(a) AS va FROM {scores} s4 GROUP BY g) m ON z.g = m.g")
define("stats", GV, "fligner -> chi2: sum(n * power(a - abar, 2)) / nullif(min(va), 0) ;; count(*) - 1e0", source="{score_sums}")
midranks("v", "value_ranks")
source("rank_sums", "SELECT g, trim(grp) AS grp, sum(rk) AS s, count(*) AS n, sum(ties * 1e0 * ties - 1) AS tie FROM {value_ranks} s1 GROUP BY g, trim(grp)")
define("stats", GV, f"kruskal_wallis -> chi2: (12e0 / ({NN} * ({NN} + 1e0)) * sum(s * s / n) - 3 * ({NN} + 1)) / nullif(1 - sum(tie) / (power({NN}, 3) - {NN}), 0) ;; {K} - 1e0", source="{rank_sums}")

# one column
source("central", "SELECT z.g, z.x - m.mu AS c, m.sd FROM {t} z JOIN (SELECT g, avg(x) AS mu, stddev_samp(x) AS sd FROM {t} k GROUP BY g) m ON z.g = m.g")
SK = "(avg(power(c, 3)) / nullif(power(avg(c * c), 1.5e0), 0))"
KU = "(avg(power(c, 4)) / nullif(power(avg(c * c), 2), 0) - 3)"
n = "count(*)"
B2 = f"(3e0 * ({n} * 1e0 * {n} + 27 * {n} - 70) * ({n} + 1) * ({n} + 3) / (({n} - 2e0) * ({n} + 5) * ({n} + 7) * ({n} + 9)))"
W2 = f"(sqrt(2 * ({B2} - 1)) - 1)"
YA = f"({SK} * sqrt(({n} + 1e0) * ({n} + 3) / (6e0 * ({n} - 2))) / sqrt(2 / ({W2} - 1)))"
ZS = f"(ln({YA} + sqrt({YA} * {YA} + 1)) / sqrt(0.5e0 * ln({W2})))"
ZX = f"(({KU} + 3 - 3e0 * ({n} - 1) / ({n} + 1)) / sqrt(24e0 * {n} * ({n} - 2) * ({n} - 3) / (power({n} + 1e0, 2) * ({n} + 3) * ({n} + 5))))"
SB = f"(6e0 * ({n} * 1e0 * {n} - 5 * {n} + 2) / (({n} + 7e0) * ({n} + 9)) * sqrt(6e0 * ({n} + 3) * ({n} + 5) / ({n} * ({n} - 2e0) * ({n} - 3))))"
ZA = f"(6 + 8 / {SB} * (2 / {SB} + sqrt(1 + 4 / ({SB} * {SB}))))"
ZD = f"(1 + {ZX} * sqrt(2 / ({ZA} - 4)))"
ZK = f"((1 - 2 / (9 * {ZA}) - sign({ZD}) * power((1 - 2 / {ZA}) / abs({ZD}), 1e0 / 3)) / sqrt(2 / (9 * {ZA})))"
define("stats", "value=x", f"""
skewness: {SK}
kurtosis: {KU}
skewtest: CASE WHEN {n} >= 8 THEN {ZS} END
kurtosistest: CASE WHEN {n} >= 5 THEN {ZK} END
normaltest: CASE WHEN {n} >= 8 THEN {ZS} * {ZS} + {ZK} * {ZK} END
jarque_bera -> chi2: {n} / 6e0 * ({SK} * {SK} + {KU} * {KU} / 4) ;; 2e0
""", source="{central}")
# about the mean, which these do not depend on: sums of powers of x itself cancel
S2, S3, S4 = "sum(c * c)", "sum(c * c * c)", "sum(c * c * c * c)"
define("stats", "value=x", f"""
kstat_third: {n} * 1e0 * {S3} / nullif(({n} - 1e0) * ({n} - 2), 0)
kstat_fourth: ({n} * ({n} + 1e0) * {S4} - 3e0 * ({n} - 1) * {S2} * {S2}) / nullif(({n} - 1e0) * ({n} - 2) * ({n} - 3), 0)
""", source="{central}")
Q = lambda q: f"percentile(x, {q})"
define("stats", "value=x", f"""
bowley_skewness: ({Q("0.75e0")} + {Q("0.25e0")} - 2 * {Q("0.5e0")}) / nullif({Q("0.75e0")} - {Q("0.25e0")}, 0)
moors_kurtosis: CASE WHEN {n} >= 8 THEN ({Q("0.875e0")} - {Q("0.625e0")} + {Q("0.375e0")} - {Q("0.125e0")}) / nullif({Q("0.75e0")} - {Q("0.25e0")}, 0) END
confidence_interval[level=0.95e0,kind=t] -> half_width: stddev_samp(x) ;; {n} ;; {{level}} ;; '{{kind}}'
""")
source("moments_x", "SELECT g, x, row_number() OVER (PARTITION BY g ORDER BY x) AS rn, count(*) OVER (PARTITION BY g) AS n FROM {t} s0")
B0 = "avg(x)"
B_1 = "(sum((rn - 1) / nullif(n - 1e0, 0) * x) / min(n))"
B_2 = "(sum((rn - 1e0) * (rn - 2) / nullif((n - 1e0) * (n - 2), 0) * x) / min(n))"
B_3 = "(sum((rn - 1e0) * (rn - 2) * (rn - 3) / nullif((n - 1e0) * (n - 2) * (n - 3), 0) * x) / min(n))"
define("stats", "value=x", f"""
l_skewness: CASE WHEN min(n) >= 4 AND max(x) > min(x) THEN (6 * {B_2} - 6 * {B_1} + {B0}) / nullif(2 * {B_1} - {B0}, 0) END
l_kurtosis: CASE WHEN min(n) >= 4 AND max(x) > min(x) THEN (20 * {B_3} - 30 * {B_2} + 12 * {B_1} - {B0}) / nullif(2 * {B_1} - {B0}, 0) END
""", source="{moments_x}")
source("spacings", "SELECT z.g, z.n, floor(sqrt(z.n * 1e0) + 0.5e0) AS m, b.x - a.x AS gap FROM {moments_x} z JOIN {moments_x} a ON z.g = a.g AND a.rn = greatest(z.rn - floor(sqrt(z.n * 1e0) + 0.5e0), 1) JOIN {moments_x} b ON z.g = b.g AND b.rn = least(z.rn + floor(sqrt(z.n * 1e0) + 0.5e0), z.n)")
define("stats", "value=x", "differential_entropy: CASE WHEN min(gap) > 0 THEN avg(ln(n / (2 * m) * gap)) END", source="{spacings}")
source("standard", "SELECT z.g, (z.x - m.mu) / nullif(m.sd, 0) AS w, row_number() OVER (PARTITION BY z.g ORDER BY z.x) AS i, m.n FROM {t} z JOIN (SELECT g, avg(x) AS mu, stddev_samp(x) AS sd, count(*) AS n FROM {t} k GROUP BY g) m ON z.g = m.g")
define("stats", "value=x", "anderson_darling: -min(n) - sum((2 * i - 1) * ln(norm_cdf(w)) + (2 * (n - i) + 1) * ln(norm_cdf(-w))) / min(n)", source="{standard}")

# p-values in a column
define("stats", "value=pv", f"""
bonferroni_rejections[alpha=0.05e0]: count_if(pv <= {{alpha}} / m)
sidak_rejections[alpha=0.05e0]: count_if(pv <= 1 - power(1 - {{alpha}}, 1e0 / m))
""", totals="count(*) AS m")
source("sorted_p", "SELECT g, pv, row_number() OVER (PARTITION BY g ORDER BY pv) AS k, count(*) OVER (PARTITION BY g) AS m FROM {t} s0")
define("stats", "value=pv", """
bh_rejections[alpha=0.05e0]: coalesce(max(k) FILTER (WHERE pv <= k / (m * 1e0) * {alpha}), 0)
holm_rejections[alpha=0.05e0]: coalesce(min(k) FILTER (WHERE pv > {alpha} / (m - k + 1)) - 1, max(m))
holm_sidak_rejections[alpha=0.05e0]: coalesce(min(k) FILTER (WHERE pv > 1 - power(1 - {alpha}, 1e0 / (m - k + 1))) - 1, max(m))
hochberg_rejections[alpha=0.05e0]: coalesce(max(k) FILTER (WHERE pv <= {alpha} / (m - k + 1)), 0)
""", source="{sorted_p}")
define("stats", "value=pv", "benjamini_yekutieli[alpha=0.05e0]: coalesce(max(k) FILTER (WHERE pv <= k / (m * cm) * {alpha}), 0)", source=with_totals("sum(1e0 / k) AS cm", "{sorted_p}"))

# flags
define("stats", "flag=flag", """
wilson_lower[level=0.95e0] -> wilson: avg(CASE WHEN flag <> 0 THEN 1e0 ELSE 0e0 END) ;; count(*) ;; {level} ;; -1e0
wilson_upper[level=0.95e0] -> wilson: avg(CASE WHEN flag <> 0 THEN 1e0 ELSE 0e0 END) ;; count(*) ;; {level} ;; 1e0
""")

# two columns
R = "(covar_pop(x, y) / nullif(stddev_pop(x) * stddev_pop(y), 0))"
SLOPE = "(covar_pop(x, y) / nullif(var_pop(x), 0))"
SE = f"(sqrt(greatest({n} * (var_pop(y) - power(covar_pop(x, y), 2) / nullif(var_pop(x), 0)), 0) / nullif({n} - 2, 0)) / nullif(sqrt({n} * var_pop(x)), 0))"
define("stats", "x=x, y=y", f"""
correlation: {R}
linregress_slope_stderr: {SE}
linregress_intercept_stderr: {SE} * sqrt(avg(x * x))
""")
define("stats", "binary=flag, value=x", "point_biserial: covar_pop(flag, x) / nullif(stddev_pop(flag) * stddev_pop(x), 0)")
define("stats", "p=dp, q=dq", """
kl_divergence: CASE WHEN count_if(a > 0 AND b <= 0) = 0 THEN sum(CASE WHEN a > 0 THEN a * ln(a / nullif(b, 0)) ELSE 0e0 END) END
js_divergence: 0.5e0 * sum(CASE WHEN a > 0 THEN a * ln(2 * a / (a + b)) ELSE 0e0 END + CASE WHEN b > 0 THEN b * ln(2 * b / (a + b)) ELSE 0e0 END)
hellinger_distance: sqrt(0.5e0 * sum(power(sqrt(a) - sqrt(b), 2)))
total_variation_distance: 0.5e0 * sum(abs(a - b))
bhattacharyya_distance: -ln(nullif(sum(sqrt(a * b)), 0))
jeffreys_divergence: CASE WHEN count_if((a > 0 AND b <= 0) OR (a <= 0 AND b > 0)) = 0 THEN sum(CASE WHEN a > 0 THEN (a - b) * ln(a / nullif(b, 0)) ELSE 0e0 END) END
chi_square_distance: sum(CASE WHEN a + b > 0 THEN power(a - b, 2) / (a + b) ELSE 0e0 END)
""", source="(SELECT z.g, greatest(z.dp, 0) / nullif(m.sp, 0) AS a, greatest(z.dq, 0) / nullif(m.sq, 0) AS b FROM {t} z JOIN (SELECT g, sum(dp) AS sp, sum(dq) AS sq FROM {t} k GROUP BY g) m ON z.g = m.g)")
midranks("x", "rank_x")
source("ranked_x", "SELECT g, y, rk AS rx FROM {rank_x} s1")
midranks("y", "rank_xy", "g", "{ranked_x}")
define("stats", "x=x, y=y", "gaussian_rank_correlation: sum(norm_ppf(rx / (n + 1e0)) * norm_ppf(rk / (n + 1e0))) / nullif(sum(power(norm_ppf(i / (n + 1e0)), 2)), 0)",
       source="(SELECT g, rx, rk, row_number() OVER (PARTITION BY g ORDER BY rk) AS i, count(*) OVER (PARTITION BY g) AS n FROM {rank_xy} s2)")
define("stats", "x=x, y=y", """
blomqvist_beta: (count_if((x - mx) * (y - my) > 0) - count_if((x - mx) * (y - my) < 0)) / nullif(count_if((x - mx) * (y - my) <> 0), 0)
""", totals="percentile(x, 0.5e0) AS mx, percentile(y, 0.5e0) AS my")
# counts of y at most and at least a value, along x
source("y_counts", "SELECT g, y, count(*) AS c FROM {t} s0 GROUP BY g, y")
source("y_ranks", "SELECT g, y, sum(c) OVER (PARTITION BY g ORDER BY y ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS r, sum(c) OVER (PARTITION BY g ORDER BY y DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS l FROM {y_counts} s1")
source("along_x", "SELECT z.g, m.l, m.r - lag(m.r) OVER (PARTITION BY z.g ORDER BY z.x, z.pos) AS d, count(*) OVER (PARTITION BY z.g) AS n FROM {t} z JOIN {y_ranks} m ON z.g = m.g AND z.y = m.y")
define("stats", "x=x, y=y", "chatterjee_xi: 1 - min(n) * sum(abs(d)) / nullif(2e0 * sum(l * (n - l)), 0)", source="{along_x}", ordered=True)

# CUPED
THETA = "(covar_samp(v, cov) / nullif(var_samp(cov), 0))"
define("stats", "value=v, covariate=cov", f"variance_reduction_cuped: power(covar_pop(v, cov) / nullif(stddev_pop(v) * stddev_pop(cov), 0), 2)")
define("stats", "value=v, covariate=cov, group=arm", f"""
cuped_ate: avg(v) FILTER (WHERE arm <> 0) - avg(v) FILTER (WHERE arm = 0) - {THETA} * (avg(cov) FILTER (WHERE arm <> 0) - avg(cov) FILTER (WHERE arm = 0))
""")

# pairs of rows by their orders, without listing them
define("stats", "x=x, y=y", """
kendall_tau: min(con - dis) / nullif(min(sqrt(apart_x) * sqrt(apart_y)), 0)
somers_d: min(con - dis) / nullif(min(con + dis + only_y), 0)
goodman_kruskal_gamma: min(con - dis) / nullif(min(con + dis), 0)
""", source="{concordance}", places=IN_PLACE)
define("stats", "x=x, y=y", "distance_correlation: CASE WHEN min(least(vxx, vyy)) > 1e-14 * max(greatest(vxx, vyy)) THEN min(sqrt(greatest(vxy, 0)) / sqrt(sqrt(vxx) * sqrt(vyy))) END", source="{distance_sums}", places=IN_PLACE)
define("stats", "time=d, score=sc, event=ev", "concordance_index: min(wins) / nullif(min(pairs), 0)", source="{ranked_events}", places=EVENT_PLACES)
# all pairs of a key: what the solvers compute by counts
source("pairs", "SELECT i.g, (i.y - j.y) / nullif(i.x - j.x, 0) AS slope FROM {t} i JOIN {t} j ON i.g = j.g AND i.pos < j.pos")
define("stats", "x=x, y=y", "theil_sen_slope: median(slope)", source="{pairs}", ordered=True, solver="theil_sen")
define("stats", "x=x, y=y", "siegel_slope: median(m)", source="(SELECT i.g, i.pos, median((i.y - j.y) / nullif(i.x - j.x, 0)) AS m FROM {t} i JOIN {t} j ON i.g = j.g AND i.pos <> j.pos GROUP BY i.g, i.pos)", ordered=True, solver="repeated_median")
# survival
source("times", "SELECT g, d, count(*) AS c, count_if(ev = 1) AS dead FROM {t} s0 GROUP BY g, d")
source("at_risk", "SELECT g, d, dead, sum(c) OVER (PARTITION BY g ORDER BY d DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS n FROM {times} s1")
source("km", "SELECT g, d, dead / (n * 1e0) AS h, exp(sum(CASE WHEN dead >= n THEN -1e9 ELSE ln(1 - dead / (n * 1e0)) END) OVER (PARTITION BY g ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS s FROM {at_risk} s2 WHERE dead > 0")
DE = "duration=d, event=ev"
define("stats", DE, """
km_median_survival: min(d) FILTER (WHERE s <= 0.5e0 + 1e-12)
km_survival_at[t_=1e0]: coalesce(min(s) FILTER (WHERE d <= {t_}), 1e0)
nelson_aalen_cumhaz[t_=1e0]: coalesce(sum(h) FILTER (WHERE d <= {t_}), 0e0)
""", source="{km}")
source("km_steps", "SELECT g, d, s, lead(d) OVER (PARTITION BY g ORDER BY d) AS d2 FROM (SELECT g, d, s FROM {km} s3 UNION ALL SELECT g, 0e0 AS d, 1e0 AS s FROM {t} s4 GROUP BY g) s5")
define("stats", DE, "restricted_mean_survival_time[horizon=1e0]: sum(s * (least(coalesce(d2, {horizon}), {horizon}) - d)) FILTER (WHERE d < {horizon})", source="{km_steps}")

# series
source("series", f"SELECT z.g, z.pos, z.x, z.x - m.mu AS c, row_number() OVER (PARTITION BY z.g ORDER BY z.pos) AS rn, m.n FROM {{t}} z JOIN (SELECT g, avg(x) AS mu, count(*) AS n FROM {{t}} k GROUP BY g) m ON z.g = m.g")
source("lag_numbers", " UNION ALL ".join(f"SELECT {k} AS k" for k in range(1, 65)))
source("acf_sums", "SELECT a.g, l.k, sum(a.c * b.c) AS s FROM {series} a JOIN {lag_numbers} l ON l.k <= {lags} JOIN {series} b ON a.g = b.g AND b.rn = a.rn - l.k GROUP BY a.g, l.k")
source("acf", "SELECT z.g, z.k, z.s / nullif(m.den, 0) AS rho, m.n FROM {acf_sums} z JOIN (SELECT g, sum(c * c) AS den, count(*) AS n FROM {series} s1 GROUP BY g) m ON z.g = m.g")
define("stats", "value=x", """
autocorrelation[lags=1]: max(CASE WHEN k = {lags} THEN rho END)
box_pierce[lags=10]: min(n) * sum(rho * rho)
ljung_box[lags=10] -> chi2: min(n) * (min(n) + 2e0) * sum(rho * rho / (n - k)) ;; count(*)
partial_autocorrelation[lags=1] -> durbin_levinson: collect_list(k) ;; collect_list(rho)
""", source="{acf}", ordered=True)
source("changes", f"SELECT g, x, x - lag(x) OVER ({W}) AS d, lead(x) OVER ({W}) - x AS e, lag(x) OVER ({W}) AS x1, x * x AS sq, lag(x * x) OVER ({W}) AS sq1, x - 2 * lag(x) OVER ({W}) + lag(x, 2) OVER ({W}) AS dd FROM {{t}} s0")
define("stats", "value=x", """
zero_crossing_rate: avg(CASE WHEN (x < 0) <> (x1 < 0) THEN 1e0 ELSE 0e0 END) FILTER (WHERE x1 IS NOT NULL)
hjorth_mobility: sqrt(var_pop(d) / nullif(var_pop(x), 0))
hjorth_complexity: sqrt(var_pop(dd) / nullif(var_pop(d), 0)) / nullif(sqrt(var_pop(d) / nullif(var_pop(x), 0)), 0)
turning_point_rate: CASE WHEN count(*) > 2 THEN count_if(d * e < 0) / (count(*) - 2) END
rms_successive_differences: sqrt(avg(d * d))
mean_absolute_change: avg(abs(d))
arch_lm: count(sq1) * power(covar_pop(sq, sq1), 2) / nullif(var_pop(sq1) * (var_pop(sq) FILTER (WHERE sq1 IS NOT NULL)), 0)
""", source="{changes}", ordered=True)
source("signs", f"SELECT g, CASE WHEN x >= {{cutoff}} THEN 1 ELSE 0 END AS i, lag(CASE WHEN x >= {{cutoff}} THEN 1 ELSE 0 END) OVER ({W}) AS i1 FROM {{t}} s0")
UP, DN = "count_if(i = 1)", "count_if(i = 0)"
RD = f"(1 + count_if(i <> i1) - 2e0 * {UP} * {DN} / {n} - 1)"
RV = f"(2e0 * {UP} * {DN} * (2e0 * {UP} * {DN} - {n}) / ({n} * 1e0 * {n} * ({n} - 1)))"
define("stats", "value=x", f"""
runs_test[cutoff=0e0]: CASE WHEN {UP} > 0 AND {DN} > 0 AND {RV} > 0 THEN (CASE WHEN {n} >= 50 THEN {RD} WHEN {RD} > 0.5e0 THEN {RD} - 0.5e0 WHEN {RD} < 0.5e0 THEN {RD} + 0.5e0 ELSE 0e0 END) / sqrt({RV}) END
""", source="{signs}", ordered=True)
LEADS = ", ".join(f"lead(x, {k}) OVER ({W}) AS x{k}" for k in range(1, 7))
source("runs_of", f"SELECT g, x AS x0, {LEADS}, row_number() OVER ({W}) AS rn, count(*) OVER (PARTITION BY g) AS n FROM {{t}} s0")
CODE = " + ".join(f"CASE WHEN {{order}} > {j} AND x{i} > x{j} THEN {1 << b} ELSE 0 END" for b, (i, j) in enumerate((i, j) for j in range(1, 7) for i in range(j)))
source("patterns", f"SELECT g, code, count(*) AS c FROM (SELECT g, {CODE} AS code FROM {{runs_of}} s1 WHERE rn <= n - {{order}} + 1) s2 GROUP BY g, code")
FACT = "CASE {order} WHEN 2 THEN 2e0 WHEN 3 THEN 6e0 WHEN 4 THEN 24e0 WHEN 5 THEN 120e0 WHEN 6 THEN 720e0 WHEN 7 THEN 5040e0 END"
define("stats", "value=x", f"permutation_entropy[order=3]: (ln(sum(c) * 1e0) - sum(c * ln(c * 1e0)) / sum(c)) / ln({FACT})", source="{patterns}", ordered=True)

# eras: predictions as normal scores of their ranks
midranks("p", "era_p", "g, era")
source("era_n", "SELECT g, era, count(*) AS n, avg(target) AS mt, min(target) AS lo, max(target) AS hi FROM {t} s0 GROUP BY g, era")
source("era_rows", "SELECT z.g, z.era, norm_ppf(least(greatest((z.rk - 0.5e0) / m.n, 1e-6), 1 - 1e-6)) AS s, z.target - m.mt AS y FROM {era_p} z JOIN {era_n} m ON z.g = m.g AND z.era = m.era AND m.n >= 2")
P15 = lambda c: f"(sign({c}) * power(abs({c}), 1.5e0))"
source("era_corr", f"SELECT g, era, covar_pop(s, y) / nullif(stddev_pop(s) * stddev_pop(y), 0) AS r FROM (SELECT g, era, {P15('s')} AS s, {P15('y')} AS y FROM {{era_rows}} s1) s2 GROUP BY g, era")
ERA = "prediction=p, target=target, era=era'"
define("stats", ERA, """
numerai_corr: avg(r)
numerai_sharpe: avg(r) / nullif(stddev_pop(r), 0)
""", source="{era_corr}")
source("era_meta", "SELECT g, era, meta, target, rk AS rp FROM {era_p} s1")
midranks("meta", "era_pm", "g, era", "{era_meta}")
source("era_scores", "SELECT z.g, z.era, norm_ppf((z.rp - 0.5e0) / m.n) AS p, norm_ppf((z.rk - 0.5e0) / m.n) AS u, (z.target - m.mt) * CASE WHEN m.lo >= 0 AND m.hi <= 1 THEN 4 ELSE 1 END AS y FROM {era_pm} z JOIN {era_n} m ON z.g = m.g AND z.era = m.era AND m.n >= 2")
define("stats", "prediction=p, target=target, meta_model=meta, era=era'", "mmc: avg(v)", source="(SELECT g, era, (sum(y * p) - sum(p * u) / nullif(sum(u * u), 0) * sum(y * u)) / count(*) AS v FROM {era_scores} s2 GROUP BY g, era)")
define("stats", "prediction=p, target=target, features=f1, feature_2=f2, era=era'", "feature_neutral_corr -> neutral_corr: collect_list(era) ;; collect_list(p) ;; collect_list(target) ;; collect_list(f1) ;; collect_list(f2)", solver="neutral_corr")
CORR = lambda f: f"abs(covar_pop(p, {f}) / nullif(stddev_pop(p) * stddev_pop({f}), 0))"
define("stats", "prediction=p, features=f1, feature_2=f2", f"max_feature_exposure: greatest({CORR('f1')}, {CORR('f2')})")

# statistics whose recipes report a tail
define("variants", GO, "chi_square_statistic[mode=yates]: max(CASE WHEN ka = 2 AND kb = 2 AND cells = 4 AND '{mode}' = 'yates' THEN yates ELSE chi END)", source="{gt_yates}")
define("variants", GO, "g_test_statistic: 2 * sum(n * ln(n * 1e0 * total / (na * 1e0 * nb)))", source="{gt_full}")
define("variants", GV, f"anova_statistic: CASE WHEN {K} > 1 THEN {SSB} / ({K} - 1) / nullif({MSW}, 0) END", source="{grouped}")
define("variants", "value=x", f"jarque_bera_statistic: {n} / 6e0 * ({SK} * {SK} + {KU} * {KU} / 4)", source="{central}")
