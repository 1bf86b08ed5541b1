"""Finance, credit, portfolios, liquidity, exposure, execution, options."""

from ..recipes import define, nearby, source

W = "PARTITION BY g ORDER BY pos"


def ratios(family: str, text: str) -> None:
    """``id: tags -> expression``, for expressions over columns named like their tags."""
    for line in text.strip().splitlines():
        name, rest = line.strip().split(": ", 1)
        tags, expr = rest.split(" => ")
        define(family, tags, f"{name}: {expr}")


SUM = lambda a, b: f"sum({a}) / nullif(sum({b}), 0)"
ratios("finance", f"""
margin_pct: value, cost => (sum(value) - sum(cost)) / nullif(sum(value), 0)
reconciliation_total: value_a, value_b => sum(value_a - value_b)
return_on_equity: net_income, equity => {SUM("net_income", "equity")}
return_on_assets: net_income, assets => {SUM("net_income", "assets")}
return_on_invested_capital: nopat, invested_capital => {SUM("nopat", "invested_capital")}
asset_turnover: revenue, assets => {SUM("revenue", "assets")}
days_sales_outstanding: receivables, revenue => {SUM("receivables", "revenue")} * 365
operating_margin: operating_income, revenue => {SUM("operating_income", "revenue")}
net_margin: net_income, revenue => {SUM("net_income", "revenue")}
free_cash_flow_margin: fcf, revenue => {SUM("fcf", "revenue")}
dividend_payout_ratio: dividends, net_income => {SUM("dividends", "net_income")}
days_inventory_outstanding: inventory, cogs => {SUM("inventory", "cogs")} * 365
days_payable_outstanding: payables, cogs => {SUM("payables", "cogs")} * 365
cash_conversion_cycle: receivables, inventory, payables, revenue, cogs => ({SUM("receivables", "revenue")} + {SUM("inventory", "cogs")} - {SUM("payables", "cogs")}) * 365
fixed_charge_coverage: ebit, lease, interest => (sum(ebit) + sum(lease)) / nullif(sum(interest) + sum(lease), 0)
dpi: contribution, distribution => CASE WHEN sum(contribution) > 0 THEN sum(distribution) / sum(contribution) END
""")
define("finance", "flag", "churn_rate[mode=churn]: avg(CASE WHEN (flag <> 0) = ('{mode}' <> 'retention') THEN 1e0 ELSE 0e0 END)")
define("finance", "contribution", """
rvpi[nav=0e0]: CASE WHEN sum(contribution) > 0 THEN {nav} / sum(contribution) END
called_pct[committed=0e0]: CASE WHEN {committed} > 0 THEN sum(contribution) / {committed} END
""")
define("finance", "contribution, distribution", """
tvpi[nav=0e0]: CASE WHEN sum(contribution) > 0 THEN (sum(distribution) + {nav}) / sum(contribution) END
carried_interest[carry=0.2e0]: CASE WHEN {carry} BETWEEN 0 AND 1 THEN {carry} * greatest(sum(distribution) - sum(contribution), 0) END
""")
define("finance", "distribution", "realization_ratio[nav=0e0]: CASE WHEN sum(distribution) + {nav} > 0 THEN sum(distribution) / (sum(distribution) + {nav}) END")
PME = "contribution, distribution, index=idx"
define("finance", PME, """
ks_pme[nav=0e0]: CASE WHEN min(idx) > 0 AND sum(contribution / idx) > 0 THEN (sum(distribution / idx) + {nav} / max_by(idx, pos)) / sum(contribution / idx) END
pme_plus_lambda[nav=0e0]: CASE WHEN min(idx) > 0 AND sum(distribution / idx) > 0 THEN (max_by(idx, pos) * sum(contribution / idx) - {nav}) / (max_by(idx, pos) * sum(distribution / idx)) END
""", ordered=True)

# bonds
PV = lambda y, w="1": f"sum({w} * cf / power(1 + ({y}), tm))"
DUR = f"({PV('{ytm}', 'tm')} / nullif({PV('{ytm}')}, 0))"
define("finance", "cashflow=cf, time=tm", f"""
bond_price[ytm=0.05e0]: CASE WHEN {{ytm}} > -1 THEN {PV("{ytm}")} END
macaulay_duration[ytm=0.05e0]: {DUR}
modified_duration[ytm=0.05e0]: {DUR} / (1 + {{ytm}})
convexity[ytm=0.05e0]: {PV("{ytm}", "tm * (tm + 1)")} / nullif({PV("{ytm}")} * power(1 + {{ytm}}, 2), 0)
dv01[ytm=0.05e0]: {DUR} / (1 + {{ytm}}) * {PV("{ytm}")} * 1e-4
weighted_average_life: sum(tm * cf) / nullif(sum(cf), 0)
effective_duration[ytm=0.05e0]: ({PV("{ytm} - 1e-4")} - {PV("{ytm} + 1e-4")}) / nullif(2 * {PV("{ytm}")} * 1e-4, 0)
effective_convexity[ytm=0.05e0]: ({PV("{ytm} + 1e-4")} + {PV("{ytm} - 1e-4")} - 2 * {PV("{ytm}")}) / nullif({PV("{ytm}")} * 1e-8, 0)
yield_to_maturity[price=100e0] -> solve_yield: collect_list(cf) ;; collect_list(tm) ;; {{price}}
""")
CV = lambda s: f"sum(cf / power(1 + z + ({s}), tm))"
SD = f"(({CV('-1e-4')} - {CV('1e-4')}) / nullif(2 * {CV('0')} * 1e-4, 0))"
define("finance", "cashflow=cf, zero_rate=z, time=tm", f"""
curve_pv: CASE WHEN min(z) > -1 THEN {CV("0")} END
spread_duration: CASE WHEN min(z) > -1 THEN {SD} END
spread_dv01: CASE WHEN min(z) > -1 THEN {SD} * {CV("0")} * 1e-4 END
z_spread[price=100e0] -> solve_spread: collect_list(cf) ;; collect_list(z) ;; collect_list(tm) ;; {{price}}
""")
define("finance", "zero_rate=z, time=tm", "annuity_factor: CASE WHEN min(z) > -1 THEN sum(1 / power(1 + z, tm)) END")
nearby("curve", "{t}", "pos, z, tm, lag(z) OVER ({W}) AS z1, lag(tm) OVER ({W}) AS t1", before=1)
define("finance", "zero_rate=z, time=tm", """
par_yield: (1 - max_by(1 / power(1 + z, tm), pos)) / nullif(sum(1 / power(1 + z, tm)), 0)
forward_rate: power(power(1 + max_by(z, pos), max_by(tm, pos)) / power(1 + max_by(z1, pos), max_by(t1, pos)), 1 / nullif(max_by(tm, pos) - max_by(t1, pos), 0)) - 1
""", source="{curve}", ordered=True)

# dated cash flows; the first is at time 0
source("dated", f"SELECT g, pos, cf, row_number() OVER ({W}) - 1 AS k FROM {{t}} m0")
NPV = "sum(cf / power(1 + {rate}, k))"
CF0 = "max(CASE WHEN k = 0 THEN cf END)"
SIGNS = "count_if(cf > 0) > 0 AND count_if(cf < 0) > 0"
define("finance", "cashflow=cf", f"""
npv[rate=0.1e0]: CASE WHEN {{rate}} > -1 THEN {NPV} END
profitability_index[rate=0.1e0]: CASE WHEN count(*) > 1 AND {CF0} < 0 THEN 1 + {NPV} / abs({CF0}) END
equivalent_annual_annuity[rate=0.1e0]: CASE WHEN count(*) > 1 THEN {NPV} * {{rate}} / nullif(1 - power(1 + {{rate}}, -(count(*) - 1)), 0) END
modified_irr[finance=0.1e0,reinvest=0.1e0]: CASE WHEN {SIGNS} THEN
  power(sum(greatest(cf, 0) / power(1 + {{reinvest}}, k)) / abs(sum(least(cf, 0) / power(1 + {{finance}}, k))), 1e0 / (count(*) - 1)) * (1 + {{reinvest}}) - 1 END
irr -> solve_irr: collect_list(cf) ;; collect_list(k) ;; 0e0
""", source="{dated}", ordered=True)
source("indexed", f"SELECT z.g, row_number() OVER (PARTITION BY z.g ORDER BY z.pos) - 1 AS k, (z.distribution - z.contribution) * m.last / z.idx AS cf FROM {{t}} z JOIN (SELECT g, max_by(idx, pos) AS last FROM {{t}} k GROUP BY g) m ON z.g = m.g")
define("finance", PME, "direct_alpha[nav=0e0] -> solve_irr: collect_list(cf) ;; collect_list(k) ;; {nav}", source="{indexed}", ordered=True)
define("finance", "value=x", "cagr[periods=1e0]: CASE WHEN count(*) > 1 AND min_by(x, pos) > 0 AND max_by(x, pos) > 0 THEN power(max_by(x, pos) / min_by(x, pos), {periods} / (count(*) - 1)) - 1 END", ordered=True)

# credit
ratios("credit", f"""
expected_loss: pd, lgd, ead => sum(pd * lgd * ead)
expected_loss_rate: pd, lgd, ead => sum(pd * lgd * ead) / nullif(sum(ead), 0)
unexpected_loss: pd, lgd, ead => CASE WHEN min(pd) >= 0 AND max(pd) <= 1 THEN sum(ead * lgd * sqrt(greatest(pd * (1 - pd), 0))) END
weighted_lgd: lgd, ead => sum(lgd * ead) / nullif(sum(ead), 0)
altman_z: x1, x2, x3, x4, x5 => avg(1.2e0 * x1 + 1.4e0 * x2 + 3.3e0 * x3 + 0.6e0 * x4 + x5)
altman_z_prime: x1, x2, x3, x4 => avg(6.56e0 * x1 + 3.26e0 * x2 + 6.72e0 * x3 + 1.05e0 * x4)
altman_z_double_prime: x1, x2, x3, x4 => avg(3.25e0 + 6.56e0 * x1 + 3.26e0 * x2 + 6.72e0 * x3 + 1.05e0 * x4)
recovery_rate: recovery, exposure => {SUM("recovery", "exposure")}
exposure_weighted_pd: pd, ead => sum(pd * ead) / nullif(sum(ead), 0)
exposure_weighted_maturity: maturity, ead => sum(maturity * ead) / nullif(sum(ead), 0)
current_ratio: current_assets, current_liabilities => {SUM("current_assets", "current_liabilities")}
quick_ratio: current_assets, inventory, current_liabilities => (sum(current_assets) - sum(inventory)) / nullif(sum(current_liabilities), 0)
interest_coverage: ebit, interest_expense => {SUM("ebit", "interest_expense")}
debt_to_equity: debt, equity => {SUM("debt", "equity")}
debt_to_ebitda: debt, ebitda => {SUM("debt", "ebitda")}
net_debt_to_ebitda: debt, cash, ebitda => (sum(debt) - sum(cash)) / nullif(sum(ebitda), 0)
ebitda_margin: ebitda, revenue => {SUM("ebitda", "revenue")}
springate_score: wc_ta, ebit_ta, ebt_cl, sales_ta => avg(1.03e0 * wc_ta + 3.07e0 * ebit_ta + 0.66e0 * ebt_cl + 0.4e0 * sales_ta)
zmijewski_score: roa, tl_ta, ca_cl => avg(-4.336e0 - 4.513e0 * roa + 5.679e0 * tl_ta + 0.004e0 * ca_cl)
capital_adequacy_ratio: capital, rwa => {SUM("capital", "rwa")}
tier1_leverage_ratio: tier1_capital, total_exposure => {SUM("tier1_capital", "total_exposure")}
provision_coverage_ratio: provisions, npl => {SUM("provisions", "npl")}
cds_implied_hazard: spread, recovery => CASE WHEN max(recovery) < 1 THEN avg(spread / nullif(1 - recovery, 0)) END
""")
DD = "((ln(asset_value / debt) + (drift - vol * vol / 2) * tm) / nullif(vol * sqrt(tm), 0))"
FIRM = "asset_value, debt, drift, vol, time=tm"
GOOD = "min(asset_value) > 0 AND min(debt) > 0 AND min(vol) > 0 AND min(tm) > 0"
define("credit", FIRM, f"""
merton_distance_to_default: CASE WHEN {GOOD} THEN avg({DD}) END
merton_pd: CASE WHEN {GOOD} THEN avg(norm_cdf(-{DD})) END
""")
STRESSED = "norm_cdf((norm_ppf(pd) + sqrt({rho}) * norm_ppf({level})) / sqrt(1 - {rho}))"
PROPER = "min(pd) > 0 AND max(pd) < 1"
define("credit", "pd, lgd, ead", f"""
asrf_capital_requirement[rho=0.15e0,level=0.999e0]: CASE WHEN {PROPER} THEN sum(ead * lgd * ({STRESSED} - pd)) END
asrf_rwa[rho=0.15e0,level=0.999e0]: CASE WHEN {PROPER} THEN 12.5e0 * sum(ead * lgd * ({STRESSED} - pd)) END
""")
define("credit", "pd", f"vasicek_conditional_pd[rho=0.15e0,level=0.999e0]: CASE WHEN {PROPER} THEN avg({STRESSED}) END")

# portfolios
ratios("portfolio", """
brinson_allocation: port_weight, bench_weight, bench_return => sum((port_weight - bench_weight) * bench_return)
brinson_selection: bench_weight, port_return, bench_return => sum(bench_weight * (port_return - bench_return))
brinson_interaction: port_weight, bench_weight, port_return, bench_return => sum((port_weight - bench_weight) * (port_return - bench_return))
brinson_total_active: port_weight, bench_weight, port_return, bench_return => sum(port_weight * port_return) - sum(bench_weight * bench_return)
active_share: port_weight, bench_weight => 0.5e0 * sum(abs(port_weight - bench_weight))
portfolio_turnover: prev_weight, curr_weight => 0.5e0 * sum(abs(curr_weight - prev_weight))
effective_number_of_bets: weight => power(sum(weight), 2) / nullif(sum(weight * weight), 0)
brinson_fachler_allocation: port_weight, bench_weight, bench_return => sum((port_weight - bench_weight) * bench_return) - (sum(port_weight) - sum(bench_weight)) * sum(bench_weight * bench_return)
geometric_excess_return: port_weight, bench_weight, port_return, bench_return => (1 + sum(port_weight * port_return)) / nullif(1 + sum(bench_weight * bench_return), 0) - 1
""")

# liquidity
ratios("liquidity", """
amihud_illiquidity: ret, dollar_volume => CASE WHEN min(dollar_volume) > 0 THEN avg(abs(ret) / nullif(dollar_volume, 0)) END
amivest_liquidity: ret, dollar_volume => sum(dollar_volume) FILTER (WHERE ret <> 0) / nullif(sum(abs(ret)), 0)
kyle_lambda: price_change, signed_volume => covar_samp(price_change, signed_volume) / nullif(var_samp(signed_volume), 0)
vwap: price, volume => sum(price * volume) / nullif(sum(volume), 0)
relative_spread: bid, ask => CASE WHEN min(bid + ask) > 0 THEN avg((ask - bid) / nullif((ask + bid) / 2, 0)) END
order_flow_imbalance: buy_volume, sell_volume => (sum(buy_volume) - sum(sell_volume)) / nullif(sum(buy_volume) + sum(sell_volume), 0)
share_turnover: volume, shares_outstanding => sum(volume) / nullif(sum(shares_outstanding), 0)
""")
nearby("price_steps", "{t}", "pos, price - lag(price) OVER ({W}) AS d", before=1)
nearby("step_pairs", "{price_steps}", "d, lag(d) OVER ({W}) AS d1", before=1)
source("moves", "SELECT * FROM {step_pairs} m1 WHERE d IS NOT NULL")
define("liquidity", "price", "roll_spread: CASE WHEN count(*) > 1 AND covar_samp(d, d1) < 0 THEN 2 * sqrt(greatest(-covar_samp(d, d1), 0)) END", source="{moves}", ordered=True)
nearby("days", "{t}", "pos, high, low, lead(high) OVER ({W}) AS high2, lead(low) OVER ({W}) AS low2", after=1)
KK = "(3 - 2 * sqrt(2e0))"
BB = "(power(ln(high / low), 2) + power(ln(high2 / low2), 2))"
AA = f"((sqrt(2 * {BB}) - sqrt({BB})) / {KK} - sqrt(power(ln(greatest(high, high2) / least(low, low2)), 2) / {KK}))"
define("liquidity", "high, low", f"""
corwin_schultz_spread: CASE WHEN min(low) > 0 AND count_if(high < low) = 0 THEN avg(CASE WHEN high2 IS NOT NULL THEN greatest(2 * (exp({AA}) - 1) / (1 + exp({AA})), 0) END) END
""", source="{days}", ordered=True)
nearby("closes", "{t}", "least(close, high, low) AS least, ln(close) AS c, (ln(high) + ln(low)) / 2 AS eta, lead((ln(high) + ln(low)) / 2) OVER ({W}) AS eta2", after=1)
define("liquidity", "close, high, low", "abdi_ranaldo_spread: CASE WHEN count(*) > 1 AND min(least) > 0 THEN CASE WHEN avg((c - eta) * (c - eta2)) > 0 THEN 2 * sqrt(greatest(avg((c - eta) * (c - eta2)), 0)) ELSE 0e0 END END", source="{closes}", ordered=True)

# exposure
LONG, SHORT = "coalesce(sum(exposure) FILTER (WHERE exposure > 0), 0)", "(-coalesce(sum(exposure) FILTER (WHERE exposure < 0), 0))"
ratios("exposure", f"""
gross_exposure: exposure => sum(abs(exposure))
net_exposure: exposure => sum(exposure)
long_exposure: exposure => {LONG}
short_exposure: exposure => {SHORT}
long_short_ratio: exposure => {LONG} / nullif({SHORT}, 0)
largest_position: exposure => max(abs(exposure)) / nullif(sum(abs(exposure)), 0)
""")
define("exposure", "weight, days_to_liquidate", "liquidity_coverage[threshold=5e0]: coalesce(sum(abs(weight)) FILTER (WHERE days_to_liquidate <= {threshold}), 0) / nullif(sum(abs(weight)), 0)")

# execution: cost against a benchmark price in basis points; side is 1 for buys, -1 for sells
for name, price, bench, times in (
    ("implementation_shortfall", "exec_price", "decision_price", 1),
    ("arrival_slippage", "exec_price", "arrival_price", 1),
    ("vwap_slippage", "exec_price", "vwap_price", 1),
    ("effective_spread_bps", "exec_price", "mid_price", 2),
    ("realized_spread_bps", "exec_price", "mid_future_price", 2),
):
    define("execution", f"{price}, {bench}, quantity", f"{name}[side=1]: {times} * {{side}} * sum(quantity * ({price} - {bench})) / nullif(sum(quantity * {bench}), 0) * 1e4")
define("execution", "mid_price, mid_future_price, quantity", "price_impact_bps[side=1]: 2 * {side} * sum(quantity * (mid_future_price - mid_price)) / nullif(sum(quantity * mid_price), 0) * 1e4")
define("execution", "order_volume, market_volume", "participation_rate: sum(order_volume) / nullif(sum(market_volume), 0)")

# options: Black-Scholes greeks; call is 1 for calls, 0 for puts
D1 = "((ln(spot / strike) + (rate + vol * vol / 2) * tm) / (vol * sqrt(tm)))"
D2 = f"({D1} - vol * sqrt(tm))"
PDF = f"(exp(-{D1} * {D1} / 2) / sqrt(2 * acos(-1e0)))"
GAMMA = f"({PDF} / (spot * vol * sqrt(tm)))"
VEGA = f"(spot * {PDF} * sqrt(tm))"
BOOK = "spot, strike, time=tm, vol, rate, quantity"
LIVE = "CASE WHEN min(spot) > 0 AND min(strike) > 0 AND min(tm) > 0 AND min(vol) > 0 THEN sum(quantity * ({})) END".format
define("derivatives", BOOK, f"""
bs_gamma: {LIVE(GAMMA)}
bs_vega: {LIVE(VEGA)}
bs_vanna: {LIVE(f"-{PDF} * {D2} / vol")}
bs_volga: {LIVE(f"{VEGA} * {D1} * {D2} / vol")}
bs_speed: {LIVE(f"-{GAMMA} / spot * ({D1} / (vol * sqrt(tm)) + 1)")}
bs_zomma: {LIVE(f"{GAMMA} * ({D1} * {D2} - 1) / vol")}
bs_charm: {LIVE(f"-{PDF} * (2 * rate * tm - {D2} * vol * sqrt(tm)) / (2 * tm * vol * sqrt(tm))")}
bs_color: {LIVE(f"-{PDF} / (2 * spot * tm * vol * sqrt(tm)) * (1 + (2 * rate * tm - {D2} * vol * sqrt(tm)) / (vol * sqrt(tm)) * {D1})")}
bs_veta: {LIVE(f"spot * {PDF} * sqrt(tm) * (rate * {D1} / (vol * sqrt(tm)) - (1 + {D1} * {D2}) / (2 * tm))")}
bs_ultima: {LIVE(f"-{VEGA} / (vol * vol) * ({D1} * {D2} * (1 - {D1} * {D2}) + {D1} * {D1} + {D2} * {D2})")}
""")
# normal tails come from row functions; {call} is 1 for calls, 0 for puts
CDF1 = f"(CASE WHEN {{call}} = 1 THEN norm_cdf({D1}) ELSE norm_cdf({D1}) - 1 END)"
CDF2 = f"(CASE WHEN {{call}} = 1 THEN norm_cdf({D2}) ELSE norm_cdf({D2}) - 1 END)"
PRICE = f"(spot * {CDF1} - strike * exp(-rate * tm) * {CDF2})"
define("derivatives", BOOK, f"""
bs_value[call=1]: {LIVE(PRICE)}
bs_delta[call=1]: {LIVE(CDF1)}
bs_theta[call=1]: {LIVE(f"-spot * {PDF} * vol / (2 * sqrt(tm)) - rate * strike * exp(-rate * tm) * {CDF2}")}
bs_rho[call=1]: {LIVE(f"strike * tm * exp(-rate * tm) * {CDF2}")}
bs_lambda[call=1]: {LIVE(f"{CDF1} * spot")} / nullif({LIVE(PRICE)}, 0)
""")
IV = "implied_vol(spot, strike, tm, rate, price, {call} * 1e0)"
define("derivatives", "spot, strike, time=tm, rate, price", f"bs_implied_vol[call=1]: CASE WHEN count({IV}) = count(*) THEN avg({IV}) END")
