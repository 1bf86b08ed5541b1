"""Classification, calibration, fairness and agreement."""

from ..recipes import define, source, with_totals
from .tables import HA, HB, MI, contingency

TP, FP, FN = "count_if(p = 1 AND y = 1)", "count_if(p = 1 AND y = 0)", "count_if(p = 0 AND y = 1)"
TN = f"(count(*) - {TP} - {FP} - {FN})"
TPR, TNR = f"({TP} / nullif({TP} + {FN}, 0))", f"({TN} / nullif({TN} + {FP}, 0))"
PPV, NPV = f"({TP} / nullif({TP} + {FP}, 0))", f"({TN} / nullif({TN} + {FN}, 0))"
FPR, FNR = f"({FP} / nullif({FP} + {TN}, 0))", f"({FN} / nullif({FN} + {TP}, 0))"
F1 = f"CASE WHEN {PPV} + {TPR} > 0 THEN 2 * {PPV} * {TPR} / ({PPV} + {TPR}) END"

define("classification", "prediction=p, label=y", f"""
accuracy: avg(CASE WHEN p = y THEN 1e0 ELSE 0e0 END)
precision: {PPV}
recall: {TPR}
f1: {F1}
specificity: {TNR}
fbeta[beta=1e0]: CASE WHEN {{beta}} > 0 THEN (1 + power({{beta}}, 2)) * {PPV} * {TPR} / nullif(power({{beta}}, 2) * {PPV} + {TPR}, 0) END
jaccard: {TP} / nullif({TP} + {FP} + {FN}, 0)
g_mean: sqrt({TPR} * {TNR})
youden_j: {TPR} + {TNR} - 1
markedness: {PPV} + {NPV} - 1
negative_predictive_value: {NPV}
false_positive_rate: {FPR}
false_negative_rate: {FNR}
false_discovery_rate: {FP} / nullif({FP} + {TP}, 0)
positive_likelihood_ratio: {TPR} / nullif({FPR}, 0)
negative_likelihood_ratio: {FNR} / nullif({TNR}, 0)
diagnostic_odds_ratio: CASE WHEN {FP} > 0 AND {FN} > 0 THEN {TP} * 1e0 * {TN} / ({FP} * 1e0 * {FN}) END
threat_score: {TP} / nullif({TP} + {FN} + {FP}, 0)
fowlkes_mallows: sqrt({PPV} * {TPR})
pabak: 2 * avg(CASE WHEN p = y THEN 1e0 ELSE 0e0 END) - 1
prevalence_threshold: (sqrt({TPR} * {FPR}) + {TNR} - 1) / nullif({TPR} + {TNR} - 1, 0)
""")
define("classification", "prediction=p, label=y", """
generalized_entropy_error[alpha=2e0]: CASE WHEN {alpha} <> 0 AND {alpha} <> 1 THEN sum(power((p - y + 1) / nullif(mu, 0), {alpha}) - 1) / (count(*) * {alpha} * ({alpha} - 1)) END
""", totals="avg(p - y + 1e0) AS mu")

# multiclass tables
contingency("y", "p", "cm")
N = "sum(t)"
PO, PE = f"(sum(hit) / {N})", f"(sum(t * 1e0 * pr) / power({N}, 2))"
POOL = f"((t + pr) / (2e0 * total))"
with_totals("sum(t) AS total", relation="{cm_classes}", name="cm_pooled")
define("classification", "prediction=p, label=y", f"""
macro_f1: avg(2e0 * hit / (t + pr))
micro_f1: 2e0 * sum(hit) / (sum(t) + sum(pr))
weighted_f1: sum(t * 2e0 * hit / (t + pr)) / {N}
mcc: CASE WHEN power({N}, 2) = sum(t * 1e0 * t) OR power({N}, 2) = sum(pr * 1e0 * pr) THEN 0e0
  ELSE ({N} * 1e0 * sum(hit) - sum(t * 1e0 * pr)) / sqrt(power({N}, 2) - sum(pr * 1e0 * pr)) / sqrt(power({N}, 2) - sum(t * 1e0 * t)) END
balanced_accuracy: avg(hit / (t * 1e0)) FILTER (WHERE t > 0)
balanced_accuracy_adjusted: (avg(hit / (t * 1e0)) FILTER (WHERE t > 0) - 1e0 / count_if(t > 0)) / nullif(1 - 1e0 / count_if(t > 0), 0)
cohen_kappa: ({PO} - {PE}) / nullif(1 - {PE}, 0)
jaccard_macro: avg(hit / (t + pr - hit * 1e0))
""", source="{cm_classes}")
define("classification", "prediction=p', label=y'", """
purity: sum(m) / sum(n)
""", source="(SELECT g, b, max(n) AS m, sum(n) AS n FROM {cm} c1 GROUP BY g, b)")
BP, BR = "(sum(n * 1e0 * n / nb) / min(total))", "(sum(n * 1e0 * n / na) / min(total))"
define("classification", "prediction=p', label=y'", f"""
bcubed_precision: {BP}
bcubed_recall: {BR}
bcubed_f1: 2 * {BP} * {BR} / nullif({BP} + {BR}, 0)
""", source="{cm_full}")
source("cm_index", "SELECT g, k, t, pr, row_number() OVER (PARTITION BY g ORDER BY k) AS i FROM {cm_classes} c4")
source("cm_seen", "SELECT c.g, CAST(0 AS DOUBLE) AS den, abs(i.i - j.i) AS w, c.n * 1e0 AS num FROM {cm} c JOIN {cm_index} i ON c.g = i.g AND c.a = i.k JOIN {cm_index} j ON c.g = j.g AND c.b = j.k")
source("cm_chance", "SELECT i.g, i.t * 1e0 * j.pr AS den, abs(i.i - j.i) AS w, CAST(0 AS DOUBLE) AS num FROM {cm_index} i JOIN {cm_index} j ON i.g = j.g")
source("cm_weights", "SELECT g, den, w, num FROM {cm_seen} c5 UNION ALL SELECT g, den, w, num FROM {cm_chance} c6")
define("classification", "prediction=p, label=y", """
cohen_kappa_linear: 1 - sum(w * num) / nullif(sum(w * den) / sum(num), 0)
cohen_kappa_quadratic: 1 - sum(w * w * num) / nullif(sum(w * w * den) / sum(num), 0)
""", source="{cm_weights}")

# scores
source("scored", "SELECT g, s, count_if(y = 1) AS p1, count_if(y <> 1) AS n1 FROM {t} c0 GROUP BY g, s")
source("rising", "SELECT g, s, p1, n1, sum(p1) OVER (PARTITION BY g ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cp, sum(n1) OVER (PARTITION BY g ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cn FROM {scored} c1")
source("falling", "SELECT g, s, p1, n1, sum(p1) OVER (PARTITION BY g ORDER BY s DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cp, sum(n1) OVER (PARTITION BY g ORDER BY s DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cn FROM {scored} c1")
AUC = "sum(p1 * (cn - n1 / 2e0)) / nullif(sum(p1) * 1e0 * sum(n1), 0)"
define("classification", "score=s, label=y", f"""
auc: {AUC}
gini_norm: 2 * {AUC} - 1
""", source="{rising}")
define("classification", "score=s, label=y", """
pr_auc[mode=average_precision]: CASE WHEN '{mode}' = 'trapezoid' THEN sum(p1 * 0.5e0 * (cp / (cp + cn * 1e0) + coalesce((cp - p1) / nullif(cp - p1 + cn - n1, 0), 1e0))) / nullif(sum(p1), 0)
  ELSE sum(p1 * 1e0 * cp / (cp + cn)) / nullif(sum(p1), 0) END
""", source="{falling}")
define("classification", "score=s, label=y", "ks_statistic: max(abs(cp / nullif(tp, 0) - cn / nullif(tn, 0)))", source="{rising}", totals="sum(p1) AS tp, sum(n1) AS tn")
define("classification", "score=s, label=y", """
hinge_loss: avg(greatest(0, 1 - (2 * y - 1) * s))
squared_hinge_loss: avg(power(greatest(0, 1 - (2 * y - 1) * s), 2))
exponential_loss: avg(exp(-(2 * y - 1) * s))
""")

# probabilities
LL = "-avg(CASE WHEN y = 1 THEN ln(q) ELSE ln(1 - q) END)"
define("classification", "prob=q, label=y", f"""
brier: avg(power(q - y, 2))
log_loss[mode=exact]: CASE WHEN '{{mode}}' = 'clip' THEN -avg(ln(CASE WHEN y = 1 THEN least(greatest(q, 1e-15), 1 - 1e-15) ELSE 1 - least(greatest(q, 1e-15), 1 - 1e-15) END))
  WHEN count_if(y = 1 AND q <= 0) + count_if(y <> 1 AND q >= 1) = 0 THEN {LL} END
d2_log_loss_score: CASE WHEN count_if(q <= 0 OR q >= 1) = 0 AND avg(y) > 0 AND avg(y) < 1 THEN 1 - ({LL}) / -(avg(y) * ln(avg(y)) + (1 - avg(y)) * ln(1 - avg(y))) END
net_benefit[threshold=0.5e0]: CASE WHEN {{threshold}} > 0 AND {{threshold}} < 1 THEN count_if(q >= {{threshold}} AND y = 1) / count(*) - count_if(q >= {{threshold}} AND y <> 1) / count(*) * {{threshold}} / (1 - {{threshold}}) END
""")
define("classification", "probability=q, label=y", """
brier_skill_score: 1 - avg(power(q - y, 2)) / nullif(avg(y) * (1 - avg(y)), 0)
calibration_in_the_large: avg(y) - avg(q)
spiegelhalter_z: sum((y - q) * (1 - 2 * q)) / nullif(sqrt(sum(power(1 - 2 * q, 2) * q * (1 - q))), 0)
""")
define("classification", "probability=q", "sharpness: stddev_samp(q)")
source("binned", "SELECT g, least(greatest(ceil(q * {bins}) - 1, 0), {bins} - 1) AS bin, count(*) AS n, avg(q) AS conf, avg(CASE WHEN y = 1 THEN 1e0 ELSE 0e0 END) AS acc FROM {t} c0 GROUP BY g, least(greatest(ceil(q * {bins}) - 1, 0), {bins} - 1)")
define("classification", "prob=q, label=y", """
ece[bins=15]: sum(n * abs(acc - conf)) / sum(n)
rms_calibration_error[bins=15]: sqrt(sum(n * power(acc - conf, 2)) / sum(n))
""", source="{binned}")
define("classification", "probability=q, label=y", """
maximum_calibration_error[bins=15]: max(abs(acc - conf))
brier_reliability[bins=15]: sum(n * power(conf - acc, 2)) / sum(n)
""", source="{binned}")
define("classification", "probability=q, label=y", "brier_resolution[bins=15]: sum(n * power(acc - yb, 2)) / sum(n)", source="{binned}", totals="sum(n * acc) / sum(n) AS yb")
source("even_bins", "SELECT g, bin, avg(q) AS conf, avg(CASE WHEN y = 1 THEN 1e0 ELSE 0e0 END) AS acc FROM (SELECT g, q, y, ntile({bins}) OVER (PARTITION BY g ORDER BY q, pos) AS bin FROM {t} c0) c1 GROUP BY g, bin")
define("classification", "prob=q, label=y", "adaptive_calibration_error[bins=15]: avg(abs(acc - conf))", source="{even_bins}", ordered=True)

# fairness, by protected group
source("by_group", f"SELECT g, trim(grp) AS grp, {TPR} AS tpr, {FPR} AS fpr, {TNR} AS tnr, {PPV} AS ppv, count_if(p = 1) / count(*) AS rate, avg(CASE WHEN p = y THEN 1e0 ELSE 0e0 END) AS acc, "
       f"{FP} / nullif({FP} + {TP}, 0) AS fdr, {FN} / nullif({FN} + {TN}, 0) AS fmr, {FN} / nullif({FP}, 0) AS ratio FROM {{t}} c0 GROUP BY g, trim(grp)")
RANGE = lambda c: f"(max({c}) - min({c}))"
RATIO = lambda c: f"(min({c}) / nullif(max({c}), 0))"
define("classification", "prediction=p, label=y, group=grp'", f"""
demographic_parity_difference: {RANGE("rate")}
demographic_parity_ratio: {RATIO("rate")}
equalized_odds_difference: CASE WHEN {RANGE("tpr")} IS NOT NULL THEN greatest({RANGE("tpr")}, {RANGE("fpr")}) END
equalized_odds_ratio: least({RATIO("tpr")}, {RATIO("fpr")})
equal_opportunity_difference: {RANGE("tpr")}
predictive_parity_difference: {RANGE("ppv")}
fpr_parity_difference: {RANGE("fpr")}
accuracy_parity_difference: {RANGE("acc")}
fdr_parity_difference: {RANGE("fdr")}
for_parity_difference: {RANGE("fmr")}
average_abs_odds_difference: 0.5e0 * ({RANGE("fpr")} + {RANGE("tpr")})
treatment_equality_difference: {RANGE("ratio")}
balanced_accuracy_parity_difference: {RANGE("(tpr + tnr) / 2")}
""", source="{by_group}")

# clusterings
contingency("ca", "cb", "clu")
PAIRS = "sum(n * (n - 1e0) / 2)"
define("classification", "labels_true=ca, labels_pred=cb", f"""
mutual_info_score: {MI}
normalized_mutual_info: CASE WHEN {HA} + {HB} = 0 THEN 1e0 ELSE 2 * {MI} / ({HA} + {HB}) END
homogeneity_score: CASE WHEN {HA} = 0 THEN 1e0 ELSE {MI} / {HA} END
completeness_score: CASE WHEN {HB} = 0 THEN 1e0 ELSE {MI} / {HB} END
v_measure_score: CASE WHEN {HA} + {HB} = 0 THEN 1e0 ELSE 2 * {MI} / ({HA} + {HB}) END
""", source="{clu_full}")
source("clu_pairs", "SELECT c.g, CAST(n AS DOUBLE) * (n - 1) / 2 AS both_, CAST(0 AS DOUBLE) AS left_, CAST(0 AS DOUBLE) AS right_, CAST(n AS DOUBLE) AS n FROM {clu} c "
       "UNION ALL SELECT g, CAST(0 AS DOUBLE), CAST(na AS DOUBLE) * (na - 1) / 2, CAST(0 AS DOUBLE), CAST(0 AS DOUBLE) FROM {clu_a} c2 UNION ALL SELECT g, CAST(0 AS DOUBLE), CAST(0 AS DOUBLE), CAST(nb AS DOUBLE) * (nb - 1) / 2, CAST(0 AS DOUBLE) FROM {clu_b} c3")
ALL = "(sum(n) * (sum(n) - 1) / 2)"
EXPECTED = f"(sum(left_) * sum(right_) / nullif({ALL}, 0))"
define("classification", "labels_true=ca, labels_pred=cb", f"""
rand_index: ({ALL} + 2 * sum(both_) - sum(left_) - sum(right_)) / nullif({ALL}, 0)
adjusted_rand_index: CASE WHEN (sum(left_) + sum(right_)) / 2 = {EXPECTED} THEN 1e0 ELSE (sum(both_) - {EXPECTED}) / ((sum(left_) + sum(right_)) / 2 - {EXPECTED}) END
fowlkes_mallows_clustering: sum(both_) / nullif(sqrt(sum(left_) * sum(right_)), 0)
""", source="{clu_pairs}")

# two raters
contingency("ra", "rb", "rat")
with_totals("sum(t) AS total", relation="{rat_classes}", name="rat_pooled")
RPO = "(sum(hit) / min(total))"
define("classification", "rater_a=ra', rater_b=rb'", f"""
percentage_agreement: {RPO}
scott_pi: ({RPO} - sum(power({POOL}, 2))) / nullif(1 - sum(power({POOL}, 2)), 0)
brennan_prediger: ({RPO} - 1e0 / count(*)) / nullif(1 - 1e0 / count(*), 0)
gwet_ac1: ({RPO} - sum({POOL} * (1 - {POOL})) / nullif(count(*) - 1, 0)) / nullif(1 - sum({POOL} * (1 - {POOL})) / nullif(count(*) - 1, 0), 0)
""", source="{rat_pooled}")
