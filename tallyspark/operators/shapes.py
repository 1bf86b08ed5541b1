"""Relations over the test tables that recipes are bound to.

name -> (table, relation, families, columns, parameters by recipe). Recipe keys
(``g``) are chosen so that every key has some thousand rows or fewer.
"""

_ROW = "l_orderkey * 100000 + l_linenumber * 10000 + l_partkey * 7 % 9973 + l_suppkey / 1e3 + l_quantity / 1e5 + l_extendedprice / 1e13"

SHAPES = {
    "returns": (
        "lineitem",
        f"""SELECT l_suppkey % 10 AS g, {_ROW} AS pos, (l_discount - 0.048e0) * 0.4e0 + (l_tax - 0.04e0) * 0.2e0 AS r,
        (l_tax - 0.038e0) * 0.3e0 + (l_discount - 0.05e0) * 0.1e0 AS b, 0.012e0 + l_tax * 0.05e0 AS v, 0.016e0 + l_tax * 0.05e0 AS es,
        CASE WHEN l_quantity > 47 THEN 1 ELSE 0 END AS flag, l_extendedprice / 1e3 AS x,
        100 + l_quantity AS o, 101 + l_quantity + l_discount * 50 AS h, 99 + l_quantity - l_tax * 50 AS l, 100 + l_quantity + l_discount * 10 - l_tax * 10 AS c FROM lineitem""",
        ("quant",),
        "r b v es flag x o h l c",
        {},
    ),
    "classes": (
        "orders",
        """SELECT o_custkey % 7 AS g, o_orderkey AS pos, CASE WHEN o_orderkey * 7919 % 1000 < 250 + CASE WHEN o_totalprice > 250000 THEN 400 ELSE 0 END THEN 1 ELSE 0 END AS p,
        CASE WHEN o_totalprice > 250000 THEN 1 ELSE 0 END AS y, (o_orderkey * 7919 % 1000 + o_totalprice / 1000) / 2000 - 0.3e0 AS s,
        (o_orderkey * 7919 % 997 + 0.5e0) / 1500 + CASE WHEN o_totalprice > 250000 THEN 0.3e0 ELSE 0e0 END AS q, o_orderpriority AS grp FROM orders""",
        ("classification",),
        "p y s q grp",
        {},
    ),
    "labels": (
        "orders",
        """SELECT o_custkey % 5 AS g, o_orderkey AS pos, o_orderkey * 31 % 4 AS ca, (o_orderkey * 31 % 4 + CASE WHEN o_totalprice > 300000 THEN 1 ELSE 0 END) % 4 AS cb,
        o_orderkey * 31 % 4 AS ra, (o_orderkey * 31 % 4 + CASE WHEN o_totalprice > 350000 THEN 1 ELSE 0 END) % 4 AS rb FROM orders""",
        ("classification",),
        "ca cb ra rb",
        {},
    ),
    "fits": (
        "lineitem",
        f"""SELECT l_suppkey % 10 AS g, {_ROW} AS pos, (l_extendedprice / 1000 + 1) * (0.9e0 + 0.02e0 * (l_partkey % 11)) AS p, l_extendedprice / 1000 + 1 AS a,
        (l_discount - 0.05e0) * l_quantity AS e, l_quantity + l_tax * 10 AS x, l_extendedprice / 100 + l_quantity AS y, l_extendedprice / 1000 - l_quantity AS lo, l_extendedprice / 1000 + l_quantity / 2 - 5 AS hi FROM lineitem""",
        ("regression", "forecasting"),
        "p a e x y lo hi",
        {},
    ),
    "columns": (
        "lineitem",
        f"""SELECT l_suppkey % 10 AS g, {_ROW} AS pos, l_quantity AS x, l_quantity + l_tax * 100 - 4 + CASE WHEN l_partkey % 9 = 0 THEN l_quantity * -0.3e0 ELSE 0e0 END AS y, l_discount + 0.01e0 AS w,
        l_quantity + l_discount AS dp, l_quantity + l_tax AS dq, CASE WHEN l_quantity > 45 THEN 1 ELSE 0 END AS flag, concat(l_returnflag, l_linestatus) AS s, l_returnflag AS lk,
        CASE WHEN l_partkey % 5 = 0 THEN NULL ELSE l_linestatus END AS jk, l_quantity / 7 AS d, CASE WHEN l_partkey % 3 = 0 THEN 'a' ELSE 'b' END AS side, l_extendedprice / 100 + CASE WHEN l_partkey % 3 = 0 THEN 20 ELSE 0 END AS v,
        l_partkey % 4 AS hits, l_extendedprice AS original, l_extendedprice * (0.3e0 + l_tax) AS compressed, l_quantity * 100 AS uptime, l_quantity AS downtime, l_partkey % 2 AS failures, l_quantity * 9 AS operating_time,
        1 + l_partkey % 3 AS repairs, l_partkey % 6 AS defects, l_quantity * 3 AS size, l_quantity * 50 AS opportunities, l_quantity * 9 AS passed, l_quantity * 10 AS total, 1 - l_tax / 1000 AS yield_step FROM lineitem""",
        ("analytics", "engineering"),
        "x y w dp dq flag s lk jk d side v hits original compressed uptime downtime failures operating_time repairs defects size opportunities passed total yield_step",
        {"groupby_aggregate": {"label": "AF", "mode": "mean"}},
    ),
    "pairs": (
        "customer",
        """SELECT c_nationkey AS g, c_custkey AS pos, c_acctbal / 100 AS x, c_acctbal / 200 + c_custkey * 37 % 101 AS y, 1 + c_custkey * 13 % 97 AS d, CASE WHEN c_custkey % 3 = 0 THEN 0 ELSE 1 END AS ev,
        c_custkey * 13 % 97 + c_custkey * 7 % 40 AS sc FROM customer""",
        ("stats",),
        "x y d ev sc",
        {"km_survival_at": {"t_": 30.0}, "nelson_aalen_cumhaz": {"t_": 30.0}, "restricted_mean_survival_time": {"horizon": 60.0}},
    ),
    "squares": (
        "lineitem",
        "SELECT l_suppkey % 10 AS g, l_linestatus AS grp, CASE WHEN l_quantity > 30 THEN 'high' ELSE 'low' END AS outcome FROM lineitem",
        ("stats", "variants"),
        "grp outcome",
        {},
    ),
    "samples": (
        "lineitem",
        f"""SELECT l_suppkey % 10 AS g, {_ROW} AS pos, CASE WHEN l_partkey % 3 = 0 THEN 'a' ELSE 'b' END AS side, l_quantity / 60 + CASE WHEN l_partkey % 3 = 0 THEN 0.01e0 ELSE 0e0 END AS v,
        l_quantity - 25 AS x, l_returnflag AS grp, l_linestatus AS outcome, CASE WHEN l_quantity > 30 THEN 1 ELSE 0 END AS y, CASE WHEN l_discount > 0.05e0 THEN 1 ELSE 0 END AS pa, CASE WHEN l_tax > 0.04e0 THEN 1 ELSE 0 END AS pb,
        l_discount * 100 AS wa, l_tax * 120 AS wb, CASE WHEN l_quantity > 40 THEN 1 ELSE 0 END AS flag, l_quantity + l_discount AS dp, l_quantity * l_quantity + l_tax AS dq, l_returnflag AS cx, concat(l_linestatus, CAST(l_partkey % 2 AS STRING)) AS cy,
        l_partkey % 2 AS arm, l_quantity + l_tax * 50 AS cov, power((l_partkey * 7919 % 1000 + 0.5e0) / 1000, 3) AS pv, CAST(l_orderkey % 8 AS STRING) AS era, l_quantity + l_discount * 10 AS p, l_discount * 4 + l_quantity / 100 AS target,
        l_tax + l_quantity / 90 AS meta, l_tax AS f1, l_discount AS f2 FROM lineitem""",
        ("stats", "variants"),
        "side v x grp outcome y pa pb wa wb flag dp dq cx cy arm cov pv era p target meta f1 f2",
        {},
    ),
    "rankings": (
        "lineitem",
        f"""SELECT l_suppkey % 10 AS g, {_ROW} AS pos, CAST(l_partkey AS STRING) AS query, l_extendedprice AS rank, CASE WHEN l_quantity > 40 THEN 2 WHEN l_quantity > 30 THEN 1 ELSE 0 END AS rel FROM lineitem""",
        ("retrieval",),
        "query rank rel",
        {},
    ),
    "answers": (
        "conversations",
        """SELECT conv_id % 5 AS g, turn AS pos, CAST(conv_id AS STRING) AS problem, CASE WHEN turn % 3 = 0 THEN 1 ELSE 0 END AS correct, -length(text) / 1000e0 AS lp FROM conversations""",
        ("llm-eval",),
        "problem correct lp",
        {},
    ),
    "strings": (
        "part",
        "SELECT p_size % 10 AS g, p_partkey AS pos, p_name AS tp, concat(p_type, substr(p_name, 3, 8)) AS tr FROM part",
        ("llm-eval", "variants"),
        "tp tr",
        {},
    ),
    "flows": (
        "customer",
        """SELECT c_nationkey AS g, c_custkey AS pos, CASE WHEN c_custkey < 60 THEN -90e0 ELSE (c_acctbal + 1000) / 100 END AS cf, 1 + c_custkey % 12 AS tm, 0.02e0 + c_custkey % 7 / 100e0 AS z,
        CASE WHEN c_custkey < 60 THEN 500e0 ELSE 20e0 END AS contribution, CASE WHEN c_custkey < 60 THEN 5e0 ELSE 150e0 + c_custkey % 9 END AS distribution, 100 + c_custkey / 50e0 AS idx FROM customer""",
        ("finance",),
        "cf tm z contribution distribution idx",
        {"rvpi": {"nav": 1e4}, "tvpi": {"nav": 1e4}, "called_pct": {"committed": 1e6}, "realization_ratio": {"nav": 1e4}, "ks_pme": {"nav": 1e3}},
    ),
    "accounts": (
        "lineitem",
        f"""SELECT l_suppkey % 10 AS g, {_ROW} AS pos, l_extendedprice AS revenue, l_extendedprice * 0.4e0 AS cogs, l_extendedprice * 0.1e0 AS net_income, l_extendedprice * 2 AS assets, l_extendedprice * 0.8e0 AS equity,
        l_extendedprice * 0.11e0 AS nopat, l_extendedprice * 1.1e0 AS invested_capital, l_quantity * 300 AS receivables, l_extendedprice * 0.15e0 AS operating_income, l_quantity * 90 AS fcf, l_quantity * 20 AS dividends,
        l_quantity * 200 AS inventory, l_quantity * 150 AS payables, l_extendedprice * 0.16e0 AS ebit, l_quantity * 10 AS lease, l_quantity * 12 AS interest, l_quantity * 13 AS interest_expense, l_quantity * 77 AS contribution,
        l_quantity * 60 + l_extendedprice / 90 AS distribution, 100 + l_quantity AS idx, l_extendedprice AS value, l_extendedprice * 0.6e0 AS cost, l_extendedprice AS value_a, l_extendedprice - l_tax AS value_b,
        CASE WHEN l_quantity > 45 THEN 1 ELSE 0 END AS flag, l_quantity AS x, l_extendedprice * 0.2e0 AS ebitda, l_extendedprice * 0.5e0 AS debt, l_quantity * 30 AS cash, l_extendedprice * 0.7e0 AS current_assets, l_quantity * 500 AS current_liabilities,
        0.001e0 + l_discount / 10 AS pd, 0.4e0 + l_tax AS lgd, l_extendedprice AS ead, l_tax AS recovery, l_extendedprice AS exposure, 1 + l_quantity / 10 AS maturity, l_tax AS x1, l_discount AS x2, l_tax * 2 AS x3, l_discount * 2 AS x4, 1.1e0 AS x5,
        l_tax AS wc_ta, l_discount AS ebit_ta, l_tax AS ebt_cl, 1.2e0 AS sales_ta, l_tax AS roa, l_discount AS tl_ta, l_quantity / 30 AS ca_cl, l_extendedprice * 0.12e0 AS capital, l_extendedprice AS rwa, l_extendedprice * 0.05e0 AS tier1_capital,
        l_extendedprice * 1.3e0 AS total_exposure, l_quantity * 5 AS provisions, l_quantity * 7 AS npl, 0.01e0 + l_tax / 10 AS spread, l_extendedprice * 1.5e0 AS asset_value, 0.05e0 AS drift, 0.2e0 + l_discount AS vol, 1 + l_quantity / 50 AS tm FROM lineitem""",
        ("finance", "credit"),
        "revenue cogs net_income assets equity nopat invested_capital receivables operating_income fcf dividends inventory payables ebit lease interest interest_expense contribution distribution idx value cost value_a value_b flag x ebitda debt "
        "cash current_assets current_liabilities pd lgd ead recovery exposure maturity x1 x2 x3 x4 x5 wc_ta ebit_ta ebt_cl sales_ta roa tl_ta ca_cl capital rwa tier1_capital total_exposure provisions npl spread asset_value drift vol tm",
        {},
    ),
    "trades": (
        "lineitem",
        f"""SELECT l_suppkey % 10 AS g, {_ROW} AS pos, l_discount AS port_weight, l_tax AS bench_weight, l_quantity / 1000 AS port_return, l_quantity / 1200 AS bench_return, l_discount AS curr_weight, l_tax AS prev_weight, l_tax - l_discount + 0.01e0 AS weight,
        l_tax - l_discount AS exposure, l_quantity / 5 AS days_to_liquidate, l_discount - 0.05e0 AS ret, l_extendedprice AS dollar_volume, l_discount - 0.04e0 AS price_change, l_quantity - 20 AS signed_volume, 100 + l_quantity AS price,
        l_quantity AS volume, 99 + l_quantity AS bid, 100 + l_quantity + l_tax AS ask, l_quantity * 3 AS buy_volume, l_quantity * 2 + l_tax AS sell_volume, l_quantity * 900 AS shares_outstanding, 101 + l_quantity + l_discount * 50 AS high,
        99 + l_quantity - l_tax * 50 AS low, 100 + l_quantity + l_discount * 10 - l_tax * 10 AS close, 100 + l_discount AS exec_price, 100e0 AS decision_price, 100 - l_tax AS arrival_price, 100 + l_tax AS vwap_price, 100 + l_discount / 2 AS mid_price,
        100 + l_tax / 3 AS mid_future_price, l_quantity AS quantity, l_quantity AS order_volume, l_quantity * 40 AS market_volume FROM lineitem""",
        ("portfolio", "liquidity", "exposure", "execution"),
        "port_weight bench_weight port_return bench_return curr_weight prev_weight weight exposure days_to_liquidate ret dollar_volume price_change signed_volume price volume bid ask buy_volume sell_volume shares_outstanding high low close exec_price "
        "decision_price arrival_price vwap_price mid_price mid_future_price quantity order_volume market_volume",
        {},
    ),
    "options": (
        "part",
        """SELECT p_size AS g, p_partkey AS pos, 100 + p_size / 2e0 AS spot, 90 + p_partkey % 30 AS strike, 0.25e0 + p_partkey % 8 / 8e0 AS tm, 0.15e0 + p_partkey % 5 / 50e0 AS vol, 0.03e0 AS rate, 1 + p_partkey % 9 AS quantity,
        greatest(100 + p_size / 2e0 - (90 + p_partkey % 30) * 0.9e0, 0) + 3 AS price FROM part""",
        ("derivatives",),
        "spot strike tm vol rate quantity price",
        {},
    ),
    "catalog": (
        "customer",
        """SELECT c_nationkey AS g, c_custkey AS pos, c_custkey * 7919 % 3 AS y, CASE WHEN c_acctbal > 2000 THEN c_custkey * 7919 % 3 ELSE 1 END AS p, c_acctbal * 0.0123456789e0 AS x, (c_acctbal - 4500) / 2e5 AS r, (c_acctbal - 4000) / 3e5 + c_custkey % 7 / 1e3 AS b,
        CASE WHEN c_custkey * 7919 % 11 > 8 THEN 2 WHEN c_custkey * 7919 % 11 > 6 THEN 1 ELSE 0 END AS rel FROM customer""",
        ("catalog",),
        "y p x r b rel",
        {},
    ),
    "catalog_scores": (
        "customer",
        "SELECT c_nationkey AS g, c_custkey AS pos, CASE WHEN c_acctbal > 4000 THEN 1 ELSE 0 END AS y, (c_acctbal + c_custkey * 37 % 5000 + 1000) / 20000 AS s FROM customer",
        ("catalog",),
        "y s",
        {},
    ),
}


def edged(name: str) -> str:
    """The relation of a shape, with its edge keys."""
    relation, columns = SHAPES[name][1], SHAPES[name][3].split()
    parts = [relation]
    ordered = ["pos"] if " AS pos," in relation else []
    if ordered:
        one = f"(SELECT * FROM ({relation}) e2 WHERE g = 0 AND pos = (SELECT min(pos) FROM ({relation}) e1 WHERE g = 0)) a"
        parts.append(f"SELECT 203 AS g, pos, {', '.join(columns)} FROM {one}")
        # in multiples of 2^-10, so that sums of ties are exact
        tied = ", ".join(f"a.{c}" if c in WORDS else f"floor(a.{c} * 1024e0) / 1024 AS {c}" for c in columns)
        parts.append(f"SELECT 202 AS g, z.pos, {tied} FROM {one} JOIN ({relation}) z ON z.g = a.g")
    for g, where, changed in EDGES.get(name, ()):
        where = where.replace("{one}", f"pos = (SELECT min(pos) FROM ({relation}) e1 WHERE g = 0)")
        parts.append(f"SELECT {g} AS g, {', '.join([*ordered, *(f'{changed.get(c, c)} AS {c}' for c in columns)])} FROM ({relation}) e WHERE g = 0 AND {where}")
    return " UNION ALL ".join(parts)


#: Columns of text.
WORDS = frozenset("grp s lk jk side outcome cx cy era query problem tp tr".split())

#: Keys of hard cases, made from the rows of key 0: (key, rows, columns changed).
EDGES = {
    # losses of everything and more, prices of nothing and less, ties only, one row, gains only
    "returns": (
        (100, "1 = 1", {"r": "CASE WHEN flag = 1 THEN -1e0 ELSE r END", "l": "CASE WHEN flag = 1 THEN 0e0 ELSE l END"}),
        (101, "1 = 1", {"r": "CASE WHEN flag = 1 THEN -1.2e0 ELSE r END", "l": "CASE WHEN flag = 1 THEN -1e0 ELSE l END"}),
        (102, "1 = 1", {"r": "0e0", "b": "0e0", "x": "1e0", "o": "5e0", "h": "5e0", "l": "5e0", "c": "5e0"}),
        (103, "{one}", {}),
        (104, "r > 0.005e0", {"x": "-x", "c": "-c"}),
    ),
    "trades": (
        (100, "1 = 1", {"low": "CASE WHEN quantity > 45 THEN 0e0 ELSE low END"}),
        (101, "1 = 1", {"low": "CASE WHEN quantity > 45 THEN -1e0 ELSE low END", "close": "CASE WHEN quantity > 45 THEN -1e0 ELSE close END"}),
        (103, "{one}", {}),
    ),
    "catalog": (
        (100, "1 = 1", {"r": "CASE WHEN rel = 2 THEN -1e0 ELSE r END"}),
        (101, "1 = 1", {"r": "CASE WHEN rel = 2 THEN -1.5e0 ELSE r END"}),
        (102, "1 = 1", {"r": "0.01e0", "b": "0.01e0", "x": "3e0", "y": "1", "p": "1", "rel": "0"}),
        (103, "{one}", {}),
    ),
}
