"""Regression and forecasting."""

from ..recipes import define, source

W = "PARTITION BY g ORDER BY pos"
E = "(p - a)"
define("regression", "prediction=p, target=a", f"""
rmse: sqrt(avg(power({E}, 2)))
mae: avg(abs({E}))
mean_squared_error: avg(power({E}, 2))
msle[mode=msle]: CASE WHEN min(p) > -1 AND min(a) > -1 THEN power(avg(power(ln(1 + p) - ln(1 + a), 2)), CASE WHEN '{{mode}}' = 'rmsle' THEN 0.5e0 ELSE 1e0 END) END
rmsle: CASE WHEN min(p) > -1 AND min(a) > -1 THEN sqrt(avg(power(ln(1 + p) - ln(1 + a), 2))) END
medae: median(abs({E}))
max_error: max(abs({E}))
explained_variance: 1 - var_pop(a - p) / nullif(var_pop(a), 0)
nrmse[mode=mean]: sqrt(avg(power({E}, 2))) / nullif(CASE WHEN '{{mode}}' = 'range' THEN max(a) - min(a) ELSE avg(a) END, 0)
concordance_correlation: 2 * covar_pop(p, a) / nullif(var_pop(p) + var_pop(a) + power(avg(p) - avg(a), 2), 0)
huber_loss[delta=1e0]: CASE WHEN {{delta}} > 0 THEN avg(CASE WHEN abs({E}) <= {{delta}} THEN {E} * {E} / 2 ELSE {{delta}} * (abs({E}) - {{delta}} / 2) END) END
poisson_deviance: CASE WHEN min(p) > 0 AND min(a) >= 0 THEN 2 * avg(CASE WHEN a > 0 THEN a * ln(a / p) ELSE 0e0 END - (a - p)) END
gamma_deviance: CASE WHEN min(p) > 0 AND min(a) > 0 THEN 2 * avg(ln(p / a) + a / p - 1) END
r2: CASE WHEN count(*) > 1 THEN 1 - sum(power({E}, 2)) / nullif(count(*) * var_pop(a), 0) END
adjusted_r2[predictors=1]: CASE WHEN count(*) - {{predictors}} - 1 > 0 THEN 1 - sum(power({E}, 2)) / nullif(count(*) * var_pop(a), 0) * (count(*) - 1) / (count(*) - {{predictors}} - 1) END
mean_tweedie_deviance[power=1.5e0]: CASE WHEN min(p) > 0 AND min(a) >= 0 THEN
  2 * avg(power(greatest(a, 0), 2 - {{power}}) / ((1 - {{power}}) * (2 - {{power}})) - a * power(p, 1 - {{power}}) / (1 - {{power}}) + power(p, 2 - {{power}}) / (2 - {{power}})) END
""")
define("regression", "prediction=p, target=a", """
d2_absolute_error: 1 - avg(abs(p - a)) / nullif(avg(abs(a - m)), 0)
""", totals="median(a) AS m")
define("regression", "prediction=p, target=a", """
d2_pinball_score[alpha=0.5e0]: 1 - avg(greatest({alpha} * (a - p), ({alpha} - 1) * (a - p))) / nullif(avg(greatest({alpha} * (a - m), ({alpha} - 1) * (a - m))), 0)
""", totals="percentile(a, {alpha}) AS m")
TW = lambda f: f"avg(power(greatest(a, 0), 2 - {{power}}) / ((1 - {{power}}) * (2 - {{power}})) - a * power({f}, 1 - {{power}}) / (1 - {{power}}) + power({f}, 2 - {{power}}) / (2 - {{power}}))"
define("regression", "prediction=p, target=a", f"""
d2_tweedie_score[power=1.5e0]: CASE WHEN min(p) > 0 AND min(a) >= 0 THEN 1 - {TW("p")} / nullif({TW("m")}, 0) END
""", totals="avg(a) AS m")

source("errors", f"SELECT g, pos, p, a, a - p AS e, lag(a - p) OVER ({W}) AS e1, lag(a) OVER ({W}) AS a1, lag(a, 1) OVER ({W}) AS a_m FROM {{t}} f0")
define("regression", "prediction=p, target=a", "durbin_watson: CASE WHEN count(*) > 1 THEN sum(power(e - e1, 2)) / nullif(sum(e * e), 0) END", source="{errors}", ordered=True)

LOGL = "(-count(*) / 2e0 * (ln(2 * acos(-1e0)) + ln(nullif(sum(e * e), 0) / count(*)) + 1))"
define("regression", "residual=e", f"""
log_likelihood_gaussian: {LOGL}
aic[k=1]: -2 * {LOGL} + 2 * {{k}}
bic[k=1]: -2 * {LOGL} + {{k}} * ln(count(*) * 1e0)
aicc[k=1]: CASE WHEN count(*) - {{k}} - 1 > 0 THEN -2 * {LOGL} + 2 * {{k}} + 2e0 * {{k}} * ({{k}} + 1) / (count(*) - {{k}} - 1) END
hqic[k=1]: CASE WHEN count(*) >= 3 THEN -2 * {LOGL} + 2 * {{k}} * ln(ln(count(*) * 1e0)) END
""")
R2 = "(power(covar_pop(e * e, x), 2) / nullif(var_pop(e * e) * var_pop(x), 0))"
define("regression", "residual=e, regressor=x", f"""
breusch_pagan_lm: count(*) * {R2}
breusch_pagan_fstat: CASE WHEN count(*) > 3 THEN {R2} / nullif(1 - {R2}, 0) * (count(*) - 2) END
""")
# e^2 on 1, x, x^2: covariances of the centred regressors give the fit
CXX, CZZ, CXZ, CXY, CZY = "var_pop(u)", "var_pop(u * u)", "covar_pop(u, u * u)", "covar_pop(u, e * e)", "covar_pop(u * u, e * e)"
define("regression", "residual=e, regressor=x", f"""
white_lm: count(*) * ({CXY} * ({CXY} * {CZZ} - {CZY} * {CXZ}) + {CZY} * ({CZY} * {CXX} - {CXY} * {CXZ})) / nullif({CXX} * {CZZ} - power({CXZ}, 2), 0) / nullif(var_pop(e * e), 0)
""", source="(SELECT g, e, (x - mx) / nullif(sx, 0) AS u FROM " + "(SELECT z.g, z.e, z.x, m.mx, m.sx FROM {t} z JOIN (SELECT g, avg(x) AS mx, stddev_pop(x) AS sx FROM {t} k GROUP BY g) m ON z.g = m.g) f1)")
source("by_regressor", "SELECT g, e AS v, x, row_number() OVER (PARTITION BY g ORDER BY x, pos) AS rn, count(*) OVER (PARTITION BY g) AS n FROM {t} f0")
HALF = lambda c: f"(regr_count(v, x) FILTER (WHERE {c}) * (var_pop(v) FILTER (WHERE {c}) - power(covar_pop(v, x) FILTER (WHERE {c}), 2) / nullif(var_pop(x) FILTER (WHERE {c}), 0)))"
define("regression", "value=e, regressor=x", f"""
goldfeld_quandt_fstat: CASE WHEN count(*) >= 6 THEN {HALF("rn > n - floor(n / 2e0)")} / nullif({HALF("rn <= floor(n / 2e0)")}, 0) END
""", source="{by_regressor}", ordered=True)

B = "(covar_pop(y, x) / nullif(var_pop(x), 0))"
SSR = "(CASE WHEN var_pop(x) > 0 THEN greatest(count(*) * (var_pop(y) - power(covar_pop(y, x), 2) / nullif(var_pop(x), 0)), 0) END)"
define("regression", "x=x, y=y", f"""
ols_slope: {B}
ols_intercept: avg(y) - {B} * avg(x)
residual_standard_error: CASE WHEN count(*) > 2 THEN sqrt({SSR} / (count(*) - 2)) END
regression_f_statistic: CASE WHEN count(*) > 2 THEN (count(*) * var_pop(y) - {SSR}) / nullif({SSR} / (count(*) - 2), 0) END
regression_t_statistic: CASE WHEN count(*) > 2 THEN {B} / nullif(sqrt({SSR} / (count(*) - 2)) / nullif(sqrt(count(*) * var_pop(x)), 0), 0) END
""")

# --- forecasting ----------------------------------------------------------------
ZERO = "count_if(a = 0) = 0"
define("forecasting", "prediction=p, target=a", f"""
mape[mode=mape]: CASE WHEN '{{mode}}' = 'smape' THEN CASE WHEN count_if(p = 0 AND a = 0) = 0 THEN avg(2 * abs({E}) / nullif(abs(p) + abs(a), 0)) END WHEN {ZERO} THEN avg(abs({E}) / nullif(abs(a), 0)) END
pinball_loss[q=0.5e0]: CASE WHEN {{q}} > 0 AND {{q}} < 1 THEN avg(greatest({{q}} * (a - p), ({{q}} - 1) * (a - p))) END
wape: sum(abs({E})) / nullif(sum(abs(a)), 0)
forecast_bias: (sum(p) - sum(a)) / nullif(sum(a), 0)
theil_u1: sqrt(avg(power({E}, 2))) / nullif(sqrt(avg(p * p)) + sqrt(avg(a * a)), 0)
tracking_signal: sum({E}) / nullif(avg(abs({E})), 0)
mean_percentage_error: CASE WHEN {ZERO} THEN avg((a - p) / a) END
median_absolute_percentage_error: CASE WHEN {ZERO} THEN median(abs({E}) / abs(a)) END
mean_arctangent_ape: avg(atan(abs((a - p) / nullif(a, 0)))) FILTER (WHERE a <> 0)
geometric_mean_absolute_error: CASE WHEN count_if(p = a) > 0 THEN 0e0 ELSE exp(avg(ln(nullif(abs({E}), 0)))) END
cumulative_forecast_error: sum(a - p)
kling_gupta_efficiency: 1 - sqrt(power(covar_pop(p, a) / nullif(stddev_pop(p) * stddev_pop(a), 0) - 1, 2) + power(stddev_pop(p) / nullif(stddev_pop(a), 0) - 1, 2) + power(avg(p) / nullif(avg(a), 0) - 1, 2))
root_mean_square_percentage_error: CASE WHEN {ZERO} THEN sqrt(avg(power((a - p) / a, 2))) END
fractional_bias: 2 * (avg(a) - avg(p)) / nullif(avg(a) + avg(p), 0)
mean_bias_error: avg({E})
log_nash_sutcliffe: CASE WHEN min(a) > 0 AND min(p) > 0 THEN 1 - sum(power(ln(a) - ln(p), 2)) / nullif(count(*) * var_pop(ln(a)), 0) END
""")
define("forecasting", "prediction=p, target=a", """
relative_absolute_error: sum(abs(p - a)) / nullif(sum(abs(a - m)), 0)
relative_squared_error: sum(power(p - a, 2)) / nullif(sum(power(a - m, 2)), 0)
nash_sutcliffe_efficiency: 1 - sum(power(a - p, 2)) / nullif(sum(power(a - m, 2)), 0)
willmott_index: 1 - sum(power(p - a, 2)) / nullif(sum(power(abs(p - m) + abs(a - m), 2)), 0)
legates_mccabe_efficiency: 1 - sum(abs(p - a)) / nullif(sum(abs(a - m)), 0)
refined_willmott_index: CASE WHEN sum(abs(p - a)) <= 2 * sum(abs(a - m)) THEN 1 - sum(abs(p - a)) / nullif(2 * sum(abs(a - m)), 0) ELSE 2 * sum(abs(a - m)) / sum(abs(p - a)) - 1 END
""", totals="avg(a) AS m")
define("forecasting", "prediction=p, target=a", """
theil_u2: CASE WHEN count_if(a1 = 0) = 0 THEN sqrt(sum(power((p - a) / nullif(a1, 0), 2))) / nullif(sqrt(sum(power((a - a1) / nullif(a1, 0), 2))), 0) END
rmsse: sqrt(avg(power(a - p, 2)) / nullif(avg(power(a - a1, 2)), 0))
mean_directional_accuracy: avg(CASE WHEN sign(a - a1) = sign(p - a1) THEN 1e0 ELSE 0e0 END) FILTER (WHERE a1 IS NOT NULL)
""", source="{errors}", ordered=True)
define("forecasting", "prediction=p, target=a", "mase[m=1]: avg(abs(p - a)) / nullif(avg(abs(a - am)), 0)", source=f"(SELECT g, p, a, lag(a, {{m}}) OVER ({W}) AS am FROM {{t}} f0)", ordered=True)
define("forecasting", "lower=lo, upper=hi", "mean_interval_width: avg(hi - lo)")
define("forecasting", "lower=lo, upper=hi, actual=a", """
interval_coverage: avg(CASE WHEN a BETWEEN lo AND hi THEN 1e0 ELSE 0e0 END)
winkler_score[alpha=0.1e0]: CASE WHEN {alpha} > 0 AND {alpha} < 1 THEN avg(hi - lo + CASE WHEN a < lo THEN 2 / {alpha} * (lo - a) WHEN a > hi THEN 2 / {alpha} * (a - hi) ELSE 0e0 END) END
coverage_deviation[alpha=0.1e0]: avg(CASE WHEN a BETWEEN lo AND hi THEN 1e0 ELSE 0e0 END) - (1 - {alpha})
""")
