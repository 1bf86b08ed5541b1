"""The trusted catalogue: the metrics a verdict rests on.

Where a name also exists as a recipe, the two differ on purpose (periods per year
1 here, precision 0 without predictions, a zero denominator of MCC degenerate), so
these carry the prefix ``catalog_``.
"""

from ..recipes import define, source
from .orders import IN_PLACE
from .quant import GROWTH
from .tables import midranks

ORDER = "PARTITION BY g ORDER BY pos"

define("catalog", "y_true=y, y_pred=p", """
catalog_accuracy: avg(CASE WHEN p = y THEN 1e0 ELSE 0e0 END)
catalog_mse: avg(power(p - y, 2))
catalog_rmse: sqrt(avg(power(p - y, 2)))
catalog_mae: avg(abs(p - y))
catalog_r2: CASE WHEN var_pop(y) > 0 THEN 1 - sum(power(p - y, 2)) / (count(*) * var_pop(y)) END
""")
# per class, out of the table of both label sets
PREC, REC = "coalesce(hit / nullif(pr * 1e0, 0), 0)", "coalesce(hit / nullif(t * 1e0, 0), 0)"
F1 = "2e0 * hit / (t + pr)"
PO, PE = "(sum(hit) / sum(t))", "(sum(t * 1e0 * pr) / power(sum(t), 2))"
define("catalog", "y_true=y, y_pred=p", f"""
catalog_precision[pos=1]: coalesce(max(CASE WHEN k = {{pos}} THEN {PREC} END), 0)
catalog_recall[pos=1]: coalesce(max(CASE WHEN k = {{pos}} THEN {REC} END), 0)
catalog_f1[pos=1]: coalesce(max(CASE WHEN k = {{pos}} THEN {F1} END), 0)
catalog_precision_macro: avg({PREC})
catalog_recall_macro: avg({REC})
catalog_f1_macro: avg({F1})
catalog_precision_micro: sum(hit) / nullif(sum(pr) * 1e0, 0)
catalog_recall_micro: sum(hit) / nullif(sum(t) * 1e0, 0)
catalog_f1_micro: 2e0 * sum(hit) / nullif(sum(t) + sum(pr), 0)
catalog_precision_weighted: sum(t * {PREC}) / sum(t)
catalog_recall_weighted: sum(t * {REC}) / sum(t)
catalog_f1_weighted: sum(t * {F1}) / sum(t)
catalog_balanced_accuracy: avg({REC}) FILTER (WHERE t > 0)
catalog_mcc: (sum(t) * 1e0 * sum(hit) - sum(t * 1e0 * pr)) / nullif(sqrt(power(sum(t), 2) - sum(pr * 1e0 * pr)) * sqrt(power(sum(t), 2) - sum(t * 1e0 * t)), 0)
catalog_cohen_kappa: ({PO} - {PE}) / nullif(1 - {PE}, 0)
""", source="{cm_classes}")
source("two_class", "SELECT z.g, z.s, CASE WHEN z.y = m.hi THEN 1 ELSE 0 END AS y, m.k FROM {t} z JOIN (SELECT g, max(y) AS hi, count(DISTINCT y) AS k FROM {t} k0 GROUP BY g) m ON z.g = m.g")
source("two_scored", "SELECT g, s, min(k) AS k, count_if(y = 1) AS p1, count_if(y <> 1) AS n1 FROM {two_class} c0 GROUP BY g, s")
source("two_rising", "SELECT g, k, p1, n1, sum(n1) OVER (PARTITION BY g ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cn FROM {two_scored} c1")
define("catalog", "y_true=y, y_score=s", "catalog_roc_auc: CASE WHEN min(k) = 2 THEN sum(p1 * (cn - n1 / 2e0)) / nullif(sum(p1) * 1e0 * sum(n1), 0) END", source="{two_rising}")
define("catalog", "y_true=y, y_score=s", "catalog_brier: CASE WHEN min(k) <= 2 THEN avg(power(s - y, 2)) END", source="{two_class}")
define("catalog", "values=x", """
catalog_mean: avg(x)
catalog_sum: sum(x)
catalog_stdev[ddof=1]: CASE WHEN {ddof} = 1 THEN stddev_samp(x) ELSE stddev_pop(x) END
catalog_variance[ddof=1]: CASE WHEN {ddof} = 1 THEN var_samp(x) ELSE var_pop(x) END
""")
SD = "(CASE WHEN {ddof} = 1 THEN stddev_samp(r) ELSE stddev_pop(r) END)"
TE = SD.replace("(r)", "(r - b)")
DOWN = "sqrt(sum(power(least(r - {rf}, 0), 2)) / nullif(CASE WHEN {full} = 1 THEN count(*) ELSE count_if(r < {rf}) END, 0))"
define("catalog", "returns=r", f"""
catalog_sharpe[periods=1e0,ddof=1,rf=0e0]: CASE WHEN count(*) > 1 AND {SD} >= 1e-12 THEN (avg(r) - {{rf}}) / {SD} * sqrt({{periods}}) END
catalog_sortino[periods=1e0,full=1,rf=0e0]: CASE WHEN count(*) > 1 AND {DOWN} >= 1e-12 THEN (avg(r) - {{rf}}) / {DOWN} * sqrt({{periods}}) END
""")
define("catalog", "returns=r", f"catalog_calmar[periods=252e0]: CASE WHEN count(*) > 0 AND {GROWTH} > 0 AND min(dd) < -1e-12 THEN (power({GROWTH}, {{periods}} / count(*)) - 1) / abs(min(dd)) END", source="{drawdown}", ordered=True)
define("catalog", "returns=r, benchmark=b", f"catalog_information_ratio[periods=1e0,ddof=1]: CASE WHEN count(*) > 1 AND {TE} >= 1e-12 THEN avg(r - b) / {TE} * sqrt({{periods}}) END")
define("catalog", "x=x, y=y", "catalog_correlation: covar_pop(x, y) / nullif(stddev_pop(x) * stddev_pop(y), 0)")
midranks("x", "by_x")
source("by_x_only", "SELECT g, y, rk AS rx FROM {by_x} s0")
midranks("y", "by_xy", "g", "{by_x_only}")
define("catalog", "x=x, y=y", "catalog_correlation_spearman: covar_pop(rx, rk) / nullif(stddev_pop(rx) * stddev_pop(rk), 0)", source="{by_xy}")
define("catalog", "x=x, y=y", "catalog_correlation_kendall: min(con - dis) / nullif(min(sqrt(apart_x) * sqrt(apart_y)), 0)", source="{concordance}", places=IN_PLACE)

# one ranked list for each key
source("ranked_list", f"SELECT g, rel, row_number() OVER ({ORDER}) AS rn, row_number() OVER (PARTITION BY g ORDER BY rel DESC) AS best, sum(CASE WHEN rel > 0 THEN 1 ELSE 0 END) OVER ({ORDER} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS found FROM {{t}} k0")
GAIN = "(CASE WHEN {exponential} = 1 THEN power(2e0, rel) - 1 ELSE rel * 1e0 END)"
CUT = lambda c: f"({{k}} = 0 OR {c} <= {{k}})"
define("catalog", "relevances=rel", f"""
catalog_ndcg[k=0,exponential=0]: sum(CASE WHEN {CUT("rn")} THEN {GAIN} / log2(rn + 1e0) ELSE 0e0 END) / nullif(sum(CASE WHEN {CUT("best")} THEN {GAIN} / log2(best + 1e0) ELSE 0e0 END), 0)
catalog_mrr: coalesce(1e0 / min(CASE WHEN rel > 0 THEN rn END), 0e0)
catalog_recall_at_k[k=0]: count_if(rel > 0 AND {CUT("rn")}) / nullif(count_if(rel > 0), 0)
catalog_precision_at_k[k=0]: count_if(rel > 0 AND {CUT("rn")}) / (CASE WHEN {{k}} = 0 THEN count(*) ELSE {{k}} END * 1e0)
catalog_hit_at_k[k=0]: CASE WHEN count_if(rel > 0 AND {CUT("rn")}) > 0 THEN 1e0 ELSE 0e0 END
catalog_average_precision: sum(CASE WHEN rel > 0 THEN found / (rn * 1e0) END) / nullif(count_if(rel > 0), 0)
""", source="{ranked_list}", ordered=True)
