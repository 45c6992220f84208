"""DuckDB SQL of the registered queries, built from named common table expressions."""

from __future__ import annotations

from ..operators.learning import RATIO_FEATURES, SCORE_FEATURES, window_days
from ..operators.ratios import ANCHOR_DAYS, CORE
from ..operators.scores import HIGH_IS_BAD, PILLARS, USE
from ..sources.adapters import HOLES, STOCKS

YEARS = (1996, 2001)
_RET = "CASE WHEN min(l_linenumber) = 7 THEN NULL ELSE round(avg(l_discount - l_tax) - 0.01, 8) END"
_X = "(l_discount - l_tax)"


def _gap(a: str, b: str) -> str:
    return f"coalesce(round(avg(CASE WHEN {a} THEN {_X} END) - avg(CASE WHEN {b} THEN {_X} END), 8), 0.0)"


def _hole(c: str, of: str | None = None) -> str:
    return f"CASE WHEN LPERMNO % {HOLES[c][0]} = {HOLES[c][1]} THEN NULL ELSE {of or c} END AS {c}" if c in HOLES else f"{of or c} AS {c}"


CTES: dict[str, str] = {
    "returns_d": f"""SELECT PERMNO, DATE, RET, CASE WHEN PERMNO % 7 = 0 AND DATE = max(DATE) OVER (PARTITION BY PERMNO) THEN -0.05 END AS DLRET FROM (
SELECT l_suppkey AS PERMNO, CAST(l_shipdate AS DATE) AS DATE, {_RET} AS RET FROM lineitem GROUP BY 1, 2)""",
    "returns_m": f"""SELECT *, CASE WHEN PERMNO % 7 = 0 AND DATE = max(DATE) OVER (PARTITION BY PERMNO) THEN -0.05 END AS DLRET FROM (
SELECT PERMNO, DATE, RET, CASE WHEN PERMNO % 11 = 0 THEN -p ELSE p END AS PRC, SHROUT, 1 + (PERMNO % 3) / 10.0::DOUBLE AS CFACSHR, round(avg(RET) OVER (PARTITION BY DATE), 8) AS VWRETD FROM (
SELECT l_suppkey AS PERMNO, CAST(date_trunc('month', l_shipdate) AS DATE) AS DATE, {_RET} AS RET, round(avg(l_extendedprice / l_quantity), 8) AS p, sum(l_quantity) AS SHROUT FROM lineitem GROUP BY 1, 2))""",
    "fund0": """SELECT l_suppkey AS LPERMNO, CAST(date_trunc('quarter', l_shipdate) + INTERVAL 3 MONTH - INTERVAL 1 DAY AS DATE) AS DATADATE, round(sum(l_extendedprice), 2) AS SALEQ,
round(sum(l_extendedprice * (0.5::DOUBLE + l_discount)), 4) AS COGSQ, round(sum(l_extendedprice * l_tax) * 0.2::DOUBLE, 5) AS XINTQ, sum(l_quantity) AS q FROM lineitem GROUP BY 1, 2""",
    "fund1": "SELECT *, round(0.1::DOUBLE * SALEQ, 4) AS XSGAQ, round(0.05::DOUBLE * SALEQ, 4) AS DPQ, round(4 * SALEQ + 1e5::DOUBLE * (LPERMNO % 9), 4) AS ATQ FROM fund0",
    "fund2": "SELECT *, round(SALEQ - COGSQ - XSGAQ, 4) AS OIBDPQ FROM fund1",
    "fund3": "SELECT *, round(OIBDPQ - XINTQ - 0.15::DOUBLE * SALEQ, 5) AS NIQ FROM fund2",
    "fundamentals_q": f"""SELECT LPERMNO, DATADATE, SALEQ, {_hole('COGSQ')}, XINTQ, XSGAQ, DPQ, OIBDPQ, {_hole('NIQ')}, {_hole('ATQ')}, {', '.join(_hole(n, f'round({a}::DOUBLE * ATQ + {b}::DOUBLE * q, 4)') for n, (a, b) in STOCKS.items())},
CAST(LPERMNO AS VARCHAR) AS GVKEY, CASE WHEN LPERMNO % 5 = 0 THEN NULL ELSE DATADATE + CAST(30 + LPERMNO % 45 AS INTEGER) END AS RDQ, CASE WHEN LPERMNO % 8 = 0 THEN DATE '1996-01-01' END AS LINKDT, CASE WHEN LPERMNO % 8 = 1 THEN DATE '1999-12-31' END AS LINKENDDT FROM fund3""",
    "factors_d": f"""SELECT CAST(l_shipdate AS DATE) AS DATE, round(avg({_X}) - 0.01, 8) AS Mkt_RF, {_gap("l_returnflag = 'A'", "l_returnflag = 'R'")} AS SMB, {_gap("l_linestatus = 'F'", "l_linestatus = 'O'")} AS HML,
{_gap('l_partkey % 2 = 0', 'l_partkey % 2 = 1')} AS RMW, {_gap('l_partkey % 3 = 0', 'l_partkey % 3 = 1')} AS CMA, {_gap('l_orderkey % 2 = 0', 'l_orderkey % 2 = 1')} AS Mom, 0.0001::DOUBLE AS RF FROM lineitem GROUP BY 1""",
    "anchors": "SELECT make_date(y::BIGINT, m::BIGINT, d::BIGINT) AS anchor FROM range(%d, %d) t(y), (VALUES %s) v(m, d)" % (YEARS[0], YEARS[1] + 1, ", ".join(map(str, ANCHOR_DAYS))),
    "days": "SELECT DISTINCT DATE FROM returns_m WHERE VWRETD IS NOT NULL",
    "asof_days": "SELECT anchor, asof_date, (SELECT max(DATE) FROM days WHERE DATE <= asof_date - 365) AS prior_date FROM (SELECT anchor, (SELECT min(DATE) FROM days WHERE DATE >= anchor) AS asof_date FROM anchors)",
    "asof_dates": "SELECT DISTINCT asof_date, prior_date FROM asof_days WHERE asof_date IS NOT NULL",
    "available": """SELECT a.asof_date, f.* FROM fundamentals_q f JOIN asof_dates a ON year(f.DATADATE) BETWEEN year(a.asof_date) - 2 AND year(a.asof_date) AND coalesce(f.RDQ, f.DATADATE + 90) <= a.asof_date
AND (f.LINKDT IS NULL OR f.LINKDT <= a.asof_date) AND (f.LINKENDDT IS NULL OR f.LINKENDDT >= a.asof_date)""",
    "measured0": "SELECT *, (ACTQ - CHEQ) - (LCTQ - DLCQ - TXPQ) AS WC, (ACTQ - CHEQ) - (LCTQ - DLCQ) AS WC_B, (ACTQ - CHEQ) - LCTQ AS WC_C, coalesce(PSTKRQ, PSTKRV, PSTKQ) AS PSTK FROM available",
    "measured1": """SELECT *, CASE WHEN count(NIQ) OVER f = 4 THEN sum(NIQ) OVER f END AS TTM_NIQ, CASE WHEN count(DPQ) OVER f = 4 THEN sum(DPQ) OVER f END AS TTM_DPQ, CASE WHEN count(OIBDPQ) OVER f = 4 THEN sum(OIBDPQ) OVER f END AS TTM_OIBDP,
CASE WHEN count(ATQ) OVER f = 4 THEN avg(ATQ) OVER f END AS AVG4_ATQ, WC - lag(WC, 4) OVER w AS WC_D4, lag(ATQ, 4) OVER w AS ATQ_lag4, WC_B - lag(WC_B, 4) OVER w AS WC_B_D4, WC_C - lag(WC_C, 4) OVER w AS WC_C_D4,
(ACTQ - lag(ACTQ) OVER w) - (CHEQ - lag(CHEQ) OVER w) - (LCTQ - lag(LCTQ) OVER w) + (DLCQ - lag(DLCQ) OVER w) + (TXPQ - lag(TXPQ) OVER w) - DPQ AS ACC_num, row_number() OVER (PARTITION BY asof_date, GVKEY ORDER BY DATADATE DESC) AS rn
FROM measured0 WINDOW w AS (PARTITION BY asof_date, GVKEY ORDER BY DATADATE), f AS (PARTITION BY asof_date, GVKEY ORDER BY DATADATE ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)""",
    "latest": """SELECT *, TTM_NIQ + TTM_DPQ - WC_D4 AS CFO_TTM, SEQQ + TXDITCQ - PSTK AS BE, coalesce(SALEQ - COGSQ, OIBDPQ + XSGAQ) AS GP_num, coalesce(SALEQ - COGSQ - XSGAQ - XINTQ, OIBDPQ - XINTQ) AS OP_num,
(ATQ - CHEQ - IVSTQ) - (LTQ - DLCQ - DLTTQ) AS NOA_full FROM measured1 WHERE rn = 1""",
    "snap": """SELECT a.asof_date, n.PERMNO, n.PRC, n.SHROUT, CASE WHEN n.SHROUT * n.CFACSHR > 0 AND p.SHROUT * p.CFACSHR > 0 THEN ln(n.SHROUT * n.CFACSHR) - ln(p.SHROUT * p.CFACSHR) END AS ns_12m
FROM asof_dates a JOIN returns_m n ON n.DATE = a.asof_date LEFT JOIN returns_m p ON p.DATE = a.prior_date AND p.PERMNO = n.PERMNO""",
    "priced": "SELECT l.*, s.PRC, s.SHROUT, s.ns_12m, abs(s.PRC) * s.SHROUT / 1000.0::DOUBLE AS MC_mn FROM latest l LEFT JOIN snap s ON s.asof_date = l.asof_date AND s.PERMNO = l.LPERMNO",
    "ev": """SELECT *, CASE WHEN A > 0 THEN A END AS EV_A, CASE WHEN A > 0 THEN A WHEN B > 0 THEN B WHEN C > 0 THEN C WHEN MC_mn > 0 THEN MC_mn END AS EV_FLEX, CASE WHEN A > 0 THEN 'A' WHEN B > 0 THEN 'B' WHEN C > 0 THEN 'C' WHEN MC_mn > 0 THEN 'D' ELSE 'NA' END AS EV_src FROM (
SELECT *, MC_mn + DLTTQ + DLCQ + PSTK + MIBQ - CHEQ - IVSTQ AS A, MC_mn + coalesce(DLTTQ, 0) + coalesce(DLCQ, 0) - coalesce(CHEQ, 0) AS B, MC_mn + coalesce(LTQ, 0) - (coalesce(LCTQ, 0) - coalesce(DLCQ, 0)) - coalesce(CHEQ, 0) AS C FROM priced)""",
    "flexed": """SELECT *, coalesce(CFO_TTM, TTM_NIQ + TTM_DPQ - WC_B_D4, TTM_NIQ + TTM_DPQ - WC_C_D4, TTM_NIQ + TTM_DPQ) AS CFO_F, CASE WHEN CFO_TTM IS NOT NULL THEN 'A' WHEN TTM_NIQ + TTM_DPQ - WC_B_D4 IS NOT NULL THEN 'B' WHEN TTM_NIQ + TTM_DPQ - WC_C_D4 IS NOT NULL THEN 'C' WHEN TTM_NIQ + TTM_DPQ IS NOT NULL THEN 'D' ELSE 'NA' END AS CFO_src,
coalesce(NOA_full, N_B, N_C, N_D) AS NOA_F, CASE WHEN NOA_full IS NOT NULL THEN 'A' WHEN N_B IS NOT NULL THEN 'B' WHEN N_C IS NOT NULL THEN 'C' WHEN N_D IS NOT NULL THEN 'D' ELSE 'NA' END AS NOA_src FROM (
SELECT *, ATQ - CHEQ - (coalesce(DLTTQ, 0) + coalesce(DLCQ, 0)) AS N_B, ATQ - CHEQ - coalesce(LTQ, 0) AS N_C, (ACTQ - CHEQ) - (LCTQ - DLCQ) AS N_D FROM ev)""",
}


def _pos(a: str, b: str) -> str:
    return f"CASE WHEN {b} > 0 THEN ({a}) / {b} END"


def _safe(a: str, b: str) -> str:
    return f"CASE WHEN {b} <> 0 THEN ({a}) / {b} END"


CTES["ratios0"] = f"""SELECT asof_date, LPERMNO AS permno, GVKEY AS gvkey, {_pos('GP_num', 'ATQ')} AS GP_AT, {_pos('OP_num', 'BE')} AS OP_BE, {_pos('TTM_NIQ', 'AVG4_ATQ')} AS ROA_TTM, {_pos('CFO_TTM', 'ATQ')} AS CFO_AT, {_safe('ACC_num', 'AVG4_ATQ')} AS SloanAcc_AT,
{_safe('ATQ - ATQ_lag4', 'ATQ_lag4')} AS AssetGrowth, {_pos('NOA_full', 'ATQ')} AS NOA_AT, ns_12m AS NetShareIss, {_pos('MC_mn', 'BE')} AS MB, {_pos('MC_mn', 'TTM_NIQ')} AS PE, {_pos('MC_mn', 'CFO_TTM')} AS PC, {_pos('EV_A', 'TTM_OIBDP')} AS EV_EBITDA_STRICT, {_pos('CFO_F', 'ATQ')} AS CFO_AT_FLEX,
{_pos('MC_mn', 'CFO_F')} AS PC_FLEX, {_safe('TTM_NIQ - CFO_F', 'AVG4_ATQ')} AS SloanAcc_AT_FLEX, {_pos('NOA_F', 'ATQ')} AS NOA_AT_FLEX, {_pos('EV_FLEX', 'TTM_OIBDP')} AS EV_EBITDA_FLEX, EV_src, CFO_src, NOA_src, MC_mn, EV_FLEX FROM flexed"""
CTES["ratios"] = "SELECT *, EV_EBITDA_FLEX AS EV_EBITDA, CAST(" + " + ".join(f"({c} IS NOT NULL)::INT" for c in CORE) + " AS INTEGER) AS core_non_null FROM ratios0"


def robust(source: str, keys: str, x: str, out: str = "z", winsor: bool = True, invert: str = "FALSE") -> str:
    """SQL of the robust z-score of `x` within `keys`."""
    part = f"PARTITION BY {keys}, _x IS NOT NULL"
    mid = lambda v, r: f"avg(CASE WHEN {r} = (_n + 1) // 2 OR {r} = _n // 2 + 1 THEN {v} END) OVER ({part})"
    rank = lambda q: f"max(CASE WHEN _r = floor((_n - 1) * {q}::DOUBLE + 0.5) + 1 THEN _x END) OVER ({part})"
    clipped = "greatest(least(_x, _hi), _lo)" if winsor else "_x"
    return f"""SELECT * EXCLUDE (_x, _n, _r, _med, _std, _lo, _hi, _dev, _dr, _scale), CASE WHEN _x IS NOT NULL THEN (CASE WHEN {invert} THEN -1 ELSE 1 END) * ({clipped} - _med) / CASE WHEN _scale > 0 THEN _scale WHEN _std > 0 THEN _std ELSE 1.0 END END AS {out} FROM (
SELECT *, 1.4826::DOUBLE * {mid('_dev', '_dr')} AS _scale FROM (SELECT *, row_number() OVER ({part} ORDER BY _dev) AS _dr FROM (SELECT *, abs(_x - _med) AS _dev FROM (
SELECT *, {mid('_x', '_r')} AS _med, stddev_samp(_x) OVER ({part}) AS _std, {rank(0.01)} AS _lo, {rank(0.99)} AS _hi FROM (
SELECT *, row_number() OVER ({part} ORDER BY _x) AS _r, count(*) OVER ({part}) AS _n FROM (SELECT *, {x} AS _x FROM {source})))))) """


_FEATURES = " UNION ALL ".join(f"SELECT asof_date, gvkey, permno, '{p}' AS pillar, '{f}' AS feature, coalesce({', '.join(USE.get(f, (f,)))}) AS x FROM ratios" for p, fs in PILLARS.items() for f in fs)
CTES["features_long"] = _FEATURES
CTES["standard"] = robust("features_long", "asof_date, feature", "x", "z", invert="feature IN (%s)" % ", ".join(f"'{f}'" for f in HIGH_IS_BAD))
CTES["pillars"] = "SELECT asof_date, gvkey, permno, " + ", ".join(f"avg(CASE WHEN pillar = '{p}' THEN z END) AS score_{p}" for p in PILLARS) + " FROM standard GROUP BY 1, 2, 3"
_T = 1 / 3
CTES["composite"] = f"""SELECT *, CASE WHEN (score_P IS NOT NULL)::INT + (score_V IS NOT NULL)::INT + (score_Q IS NOT NULL)::INT >= 2 THEN
(coalesce(score_P * {_T}::DOUBLE, 0) + coalesce(score_V * {_T}::DOUBLE, 0) + coalesce(score_Q * {_T}::DOUBLE, 0)) / ({_T}::DOUBLE * ((score_P IS NOT NULL)::INT + (score_V IS NOT NULL)::INT + (score_Q IS NOT NULL)::INT)) END AS score FROM pillars"""
CTES["ranking"] = "SELECT asof_date, CAST(row_number() OVER (PARTITION BY asof_date ORDER BY score DESC, permno) AS INTEGER) AS rank, gvkey, permno, score FROM composite WHERE score IS NOT NULL"
CTES["score_z"] = robust("ranking", "asof_date", "score", "score_z", winsor=False)
CTES["indexed"] = "SELECT asof_date, row_number() OVER (ORDER BY asof_date) - 1 AS idx FROM (SELECT DISTINCT asof_date FROM ranking)"


def dynamics(keys: str) -> str:
    return f"""SELECT w.asof_date, {keys}, CAST(k AS BIGINT) AS n_obs, CASE WHEN k * stt - st * st > 0 AND k >= 8 THEN (k * sst - st * ss) / (k * stt - st * st) END AS slope_score, CASE WHEN k >= 8 THEN mean END AS avg_score, CASE WHEN nd >= 7 THEN vol END AS vol_dscore FROM (
SELECT window_end, {keys}, count(*) AS k, sum(t) AS st, sum(t * t) AS stt, sum(score_z) AS ss, sum(score_z * t) AS sst, avg(score_z) AS mean, stddev_samp(change) AS vol, count(change) AS nd FROM (
SELECT *, score_z - lag(score_z) OVER (PARTITION BY window_end, {keys} ORDER BY t) AS change FROM (
SELECT e.idx AS window_end, s.*, CAST(i.idx - e.idx + 11 AS DOUBLE) AS t FROM score_z s JOIN indexed i ON i.asof_date = s.asof_date JOIN indexed e ON e.idx BETWEEN i.idx AND i.idx + 11 AND e.idx >= 11)) GROUP BY window_end, {keys}) x JOIN indexed w ON w.idx = x.window_end"""


CTES["dynamics"] = dynamics("permno, gvkey")
CTES["dyn_long"] = " UNION ALL ".join(f"SELECT asof_date, gvkey, permno, '{c}' AS feature, {c} AS x FROM dynamics" for c in ("slope_score", "avg_score", "vol_dscore"))
CTES["dyn_z"] = robust("dyn_long", "asof_date, feature", "x", "z", invert="feature = 'vol_dscore'")
CTES["invest"] = "SELECT asof_date, CAST(row_number() OVER (PARTITION BY asof_date ORDER BY score DESC, permno) AS INTEGER) AS rank, gvkey, permno, score FROM (SELECT asof_date, gvkey, permno, avg(z) AS score FROM dyn_z GROUP BY 1, 2, 3) WHERE score IS NOT NULL"
CTES["features"] = "SELECT asof_date AS date, permno FROM ratios"
CTES["cum"] = "SELECT PERMNO, DATE, sum(CASE WHEN RET > -1 THEN ln(1 + RET) ELSE 0.0 END) OVER (PARTITION BY PERMNO ORDER BY DATE) AS cumlog FROM returns_d"
CTES["trading_days"] = "SELECT DISTINCT DATE FROM returns_d"


def labels(truncated: bool, features: str = "features") -> str:
    keep = "" if truncated else "WHERE target <= (SELECT max(DATE) FROM returns_d)"
    return f"""SELECT t.date, t.permno, t.horizon, exp(e.cumlog - s.cumlog) - 1 AS y
FROM (SELECT *, (SELECT max(DATE) FROM trading_days d WHERE d.DATE <= target) AS end_date
      FROM (SELECT DISTINCT date, permno, horizon, CAST(date + to_months(m) AS DATE) AS target
            FROM {features}, (VALUES ('3mo', 3), ('6mo', 6), ('1y', 12)) h(horizon, m)) {keep}) t
ASOF JOIN cum s ON s.PERMNO = t.permno AND s.DATE <= t.date
ASOF JOIN cum e ON e.PERMNO = t.permno AND e.DATE <= t.end_date"""


def windows(features: str, days: int) -> str:
    """Anchors with `days` and a year of history on a panel of 12 dates or more, and the dates of their windows."""
    return f"""SELECT a.date AS dt, b.date FROM (SELECT DISTINCT date FROM {features}) a, (SELECT DISTINCT date FROM {features}) b
WHERE (SELECT count(DISTINCT date) FROM {features}) >= 12 AND a.date - (SELECT min(date) FROM {features}) >= {days} + 365 AND b.date >= a.date - {days} AND b.date < a.date"""


def solved(name: str, source: str, keys: str, n: int) -> None:
    """Add CTE `name`: Gauss-Jordan elimination, a pivot a round, of the n rows i of each key of `source` (keys, i, j, v)."""
    on = lambda *more: f"OVER (PARTITION BY {', '.join([keys, *more])})"
    CTES[name] = f"""SELECT 0 AS k, {keys}, i, j, v FROM {source} UNION ALL
SELECT k + 1, {keys}, i, j, CASE WHEN i = k THEN v / piv ELSE v - of_column * of_row / piv END
FROM (SELECT *, max(CASE WHEN i = k AND j = k THEN v END) {on()} AS piv, max(CASE WHEN i = k THEN v END) {on('j')} AS of_row,
      max(CASE WHEN j = k THEN v END) {on('i')} AS of_column FROM {name}) WHERE k < {n}"""


def ridge(name: str, features: str, labels: str, windows: str, columns: tuple[str, ...], alpha: float = 10.0, half_life: float = 1.5) -> None:
    """Add CTEs of the walk-forward ridge ranking: `name` has date, permno, pred_12m, rank."""
    n = len(columns)
    every = [*columns, *[f"miss_{c}" for c in columns]]
    months = "to_months(CASE l.horizon WHEN '3mo' THEN 3 WHEN '6mo' THEN 6 ELSE 12 END)"
    filled = ", ".join(f"coalesce(q.{c}, m.{c})" for c in columns) + ", " + ", ".join(f"CASE WHEN q.{c} IS NULL THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END" for c in columns)
    CTES[f"{name}_median"] = f"SELECT w.dt, {', '.join(f'coalesce(median({c}), 0.0) AS {c}' for c in columns)} FROM {features} q JOIN {windows} w ON w.date = q.date GROUP BY w.dt"
    CTES[f"{name}_train"] = f"""SELECT w.dt, l.horizon, q.date, q.permno, l.y, [{filled}] AS x, greatest(1e-8::DOUBLE, exp(-ln(2.0::DOUBLE) * (w.dt - q.date) / 365.2425::DOUBLE / {half_life}::DOUBLE)) AS w
FROM {features} q JOIN {windows} w ON w.date = q.date JOIN {labels} l ON l.date = q.date AND l.permno = q.permno JOIN {name}_median m ON m.dt = w.dt WHERE CAST(q.date + {months} AS DATE) <= w.dt"""
    CTES[f"{name}_long"] = f"SELECT dt, horizon, date, permno, y, w, unnest(x) AS x, generate_subscripts(x, 1) - 1 AS i FROM {name}_train"
    CTES[f"{name}_mean"] = f"SELECT dt, horizon, i, sum(w) AS ws, sum(w * x) / sum(w) AS mx, sum(w * y) / sum(w) AS my FROM {name}_long GROUP BY 1, 2, 3"
    CTES[f"{name}_centred"] = f"SELECT l.dt, l.horizon, l.date, l.permno, l.i, l.w, l.x - m.mx AS x, l.y - m.my AS y FROM {name}_long l JOIN {name}_mean m ON m.dt = l.dt AND m.horizon = l.horizon AND m.i = l.i"
    CTES[f"{name}_sums"] = f"""SELECT a.dt, a.horizon, a.i, b.i AS j, sum(a.w * a.x * b.x) AS s FROM {name}_centred a JOIN {name}_centred b ON b.dt = a.dt AND b.horizon = a.horizon AND b.date = a.date AND b.permno = a.permno GROUP BY 1, 2, 3, 4
UNION ALL SELECT dt, horizon, i, {2 * n}, sum(w * x * y) FROM {name}_centred GROUP BY 1, 2, 3"""
    CTES[f"{name}_scale"] = f"SELECT s.dt, s.horizon, s.i, s.s / m.ws > 0 AS used, sqrt(greatest(s.s / m.ws, 1e-12::DOUBLE)) AS scale, m.mx, m.my FROM {name}_sums s JOIN {name}_mean m ON m.dt = s.dt AND m.horizon = s.horizon AND m.i = s.i WHERE s.i = s.j"
    CTES[f"{name}_system"] = f"""SELECT s.dt, s.horizon, s.i, s.j, s.s / a.scale / coalesce(b.scale, 1) + CASE WHEN s.i = s.j THEN {alpha}::DOUBLE ELSE 0 END AS v
FROM {name}_sums s JOIN {name}_scale a ON a.dt = s.dt AND a.horizon = s.horizon AND a.i = s.i LEFT JOIN {name}_scale b ON b.dt = s.dt AND b.horizon = s.horizon AND b.i = s.j"""
    solved(f"{name}_solved", f"{name}_system", "dt, horizon", 2 * n)
    CTES[f"{name}_beta"] = f"SELECT v.dt, v.horizon, v.i, CASE WHEN s.used THEN v.v / s.scale ELSE 0 END AS beta, s.mx, s.my FROM {name}_solved v JOIN {name}_scale s ON s.dt = v.dt AND s.horizon = v.horizon AND s.i = v.i WHERE v.k = {2 * n} AND v.j = {2 * n}"
    CTES[f"{name}_now"] = f"SELECT dt, permno, unnest(x) AS x, generate_subscripts(x, 1) - 1 AS i FROM (SELECT q.date AS dt, q.permno, [{filled}] AS x FROM {features} q JOIN {name}_median m ON m.dt = q.date)"
    CTES[f"{name}_pred"] = f"SELECT x.dt AS date, x.permno, b.horizon, any_value(b.my) + sum((x.x - b.mx) * b.beta) AS pred, CASE b.horizon WHEN '3mo' THEN 0.2::DOUBLE WHEN '6mo' THEN 0.3::DOUBLE ELSE 0.5::DOUBLE END AS w FROM {name}_now x JOIN {name}_beta b ON b.dt = x.dt AND b.i = x.i GROUP BY 1, 2, 3"
    CTES[name] = f"SELECT *, CAST(row_number() OVER (PARTITION BY date ORDER BY pred_12m DESC, permno) AS INTEGER) AS rank FROM (SELECT date, permno, sum(pred * w) / sum(w) AS pred_12m FROM {name}_pred GROUP BY 1, 2)"


CTES["labels"] = labels(False)
CTES["windows"] = windows("features", window_days(3.0))
CTES["ratio_features"] = "SELECT asof_date AS date, * EXCLUDE (asof_date) FROM ratios"
CTES["score_features"] = "SELECT asof_date AS date, permno, avg_score, slope_score, vol_dscore FROM dynamics WHERE avg_score IS NOT NULL OR slope_score IS NOT NULL OR vol_dscore IS NOT NULL"
CTES["score_labels"] = labels(False, "score_features")
CTES["score_windows"] = windows("score_features", window_days(1.0))
ridge("ridge_ratios", "ratio_features", "labels", "windows", RATIO_FEATURES)
ridge("ridge_scores", "score_features", "score_labels", "score_windows", SCORE_FEATURES)
CTES["selection"] = """SELECT model, asof_date, permno, CAST(CASE WHEN top <= n THEN 1 WHEN low <= n THEN -1 END AS INTEGER) AS signal FROM (SELECT *, row_number() OVER (PARTITION BY model, asof_date, top > n ORDER BY score, permno) AS low FROM (
SELECT *, row_number() OVER (PARTITION BY model, asof_date ORDER BY score DESC, permno) AS top, greatest(1, floor(0.1::DOUBLE * count(*) OVER (PARTITION BY model, asof_date))) AS n FROM (
SELECT 'composite' AS model, asof_date, permno, score FROM ranking UNION ALL SELECT 'investment', asof_date, permno, score FROM invest
UNION ALL SELECT 'ridge', date, permno, pred_12m FROM ridge_ratios UNION ALL SELECT 'ridge_scores', date, permno, pred_12m FROM ridge_scores))) WHERE top <= n OR low <= n"""
CTES["cohorts"] = """SELECT c.model, c.asof_date, coalesce(max(l.asof_date), make_date(year(c.asof_date) + 1, month(c.asof_date), least(day(c.asof_date), 28))) AS end_date, any_value(n_long) AS n_long, any_value(n_short) AS n_short FROM (
SELECT model, asof_date, count(*) FILTER (signal = 1) AS n_long, count(*) FILTER (signal = -1) AS n_short FROM selection GROUP BY 1, 2) c
LEFT JOIN (SELECT DISTINCT model, asof_date FROM selection) l ON l.model = c.model AND year(l.asof_date) = year(c.asof_date) + 1 AND month(l.asof_date) = month(c.asof_date) GROUP BY 1, 2"""
CTES["held"] = """SELECT s.model, s.asof_date, c.end_date, s.permno, s.signal, r.DATE, product((1 + coalesce(r.RET, 0)) * (1 + coalesce(r.DLRET, 0))) OVER (PARTITION BY s.model, s.asof_date, s.signal, s.permno ORDER BY r.DATE) AS gross
FROM selection s JOIN cohorts c ON c.model = s.model AND c.asof_date = s.asof_date JOIN returns_d r ON r.PERMNO = s.permno AND r.DATE > s.asof_date AND r.DATE < c.end_date"""
CTES["nav"] = "SELECT model, asof_date, end_date, DATE, avg(CASE WHEN signal = 1 THEN gross END) AS nav_long, avg(CASE WHEN signal = -1 THEN gross END) AS nav_short FROM held GROUP BY 1, 2, 3, 4"
CTES["sleeves"] = """SELECT * FROM (SELECT model, asof_date, end_date, DATE, nav_long / lag(nav_long) OVER w - 1 AS long_ret, nav_short / lag(nav_short) OVER w - 1 AS short_ret FROM nav WINDOW w AS (PARTITION BY model, asof_date ORDER BY DATE)) WHERE long_ret IS NOT NULL AND short_ret IS NOT NULL"""
CTES["live"] = """SELECT model, rebal, asof_date, coalesce(n_long / nullif(sum(n_long) OVER w, 0), 0.0) AS w_long, coalesce(n_short / nullif(sum(n_short) OVER w, 0), 0.0) AS w_short FROM (
SELECT c.model, r.rebal, c.asof_date, CAST(c.n_long AS DOUBLE) AS n_long, CAST(c.n_short AS DOUBLE) AS n_short FROM (SELECT DISTINCT model, asof_date AS rebal FROM selection) r JOIN cohorts c ON c.model = r.model AND c.asof_date < r.rebal AND r.rebal < c.end_date) WINDOW w AS (PARTITION BY model, rebal)"""
CTES["daily"] = """SELECT model, DATE, long_ret, short_ret, long_ret - short_ret AS ls_ret FROM (SELECT s.model, s.DATE, sum(s.long_ret * coalesce(l.w_long, 0)) AS long_ret, sum(s.short_ret * coalesce(l.w_short, 0)) AS short_ret FROM (
SELECT *, (SELECT max(asof_date) FROM selection x WHERE x.asof_date <= sleeves.DATE) AS rebal FROM sleeves) s LEFT JOIN live l ON l.model = s.model AND l.rebal = s.rebal AND l.asof_date = s.asof_date WHERE s.rebal IS NOT NULL GROUP BY 1, 2)"""
CTES["series"] = "SELECT model, 'LS' AS series, DATE, ls_ret AS r FROM daily UNION ALL SELECT model, 'LONG', DATE, long_ret FROM daily UNION ALL SELECT model, 'SHORT', DATE, -short_ret FROM daily"
CTES["aligned"] = "SELECT s.*, f.Mkt_RF, f.SMB, f.HML, f.RMW, f.CMA, f.Mom FROM series s JOIN factors_d f ON f.DATE = s.DATE WHERE s.r IS NOT NULL"
CTES["report_rows"] = """SELECT model, series, DATE, r, Mkt_RF AS m FROM aligned
UNION ALL SELECT d.model, 'Mkt', d.DATE, f.Mkt_RF, f.Mkt_RF FROM (SELECT DISTINCT model, DATE FROM daily) d JOIN factors_d f ON f.DATE = d.DATE"""
CTES["report_wealth"] = "SELECT *, product(1 + r) OVER (PARTITION BY model, series ORDER BY DATE) AS v FROM report_rows"
CTES["report_fall"] = """SELECT model, series, min(dd) AS max_drawdown, min(DATE) AS first, arg_min(DATE, (dd, DATE)) AS trough, arg_min(peak, (dd, DATE)) AS peak
FROM (SELECT *, v / peak - 1 AS dd FROM (SELECT *, max(v) OVER (PARTITION BY model, series ORDER BY DATE) AS peak FROM report_wealth)) GROUP BY 1, 2"""
CTES["wealth"] = "SELECT *, product(1 + r) OVER (PARTITION BY model, series ORDER BY DATE) AS v FROM series"
_FACTORS = ("1.0::DOUBLE", "Mkt_RF", "SMB", "HML", "RMW", "CMA", "Mom")
CTES["ols_x"] = f"SELECT model, series, DATE, r, unnest([{', '.join(_FACTORS)}]) AS x, generate_subscripts([{', '.join(_FACTORS)}], 1) - 1 AS i FROM aligned"
CTES["ols_system"] = """SELECT a.model, a.series, a.i, b.i AS j, sum(a.x * b.x) AS v FROM ols_x a JOIN ols_x b ON b.model = a.model AND b.series = a.series AND b.DATE = a.DATE GROUP BY 1, 2, 3, 4
UNION ALL SELECT model, series, i, 7, sum(x * r) FROM ols_x GROUP BY 1, 2, 3
UNION ALL SELECT model, series, a.i, b.i + 8, CASE WHEN a.i = b.i THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END FROM (SELECT DISTINCT model, series, i FROM ols_x) a, range(7) b(i)"""
solved("ols_solved", "ols_system", "model, series", 7)
CTES["ols_sample"] = "SELECT model, series, count(*) AS N, min(DATE) AS sample_start, max(DATE) AS sample_end, sum(r) AS sr, sum(r * r) AS yy FROM aligned GROUP BY 1, 2"
CTES["ols_fit"] = """SELECT s.model, s.series, any_value(s.N) AS N, any_value(s.yy) - sum(b.v * y.v) AS rss, any_value(s.yy) - any_value(s.sr) ^ 2 / any_value(s.N) AS tss
FROM ols_sample s JOIN ols_solved b ON b.model = s.model AND b.series = s.series AND b.k = 7 AND b.j = 7 JOIN ols_system y ON y.model = s.model AND y.series = s.series AND y.i = b.i AND y.j = 7 GROUP BY 1, 2"""
CTES["ols_t"] = """SELECT b.model, b.series, b.i, b.v AS beta, b.v / sqrt(greatest(f.rss / (f.N - 7) * d.v, 0)) AS t FROM ols_solved b JOIN ols_solved d ON d.model = b.model AND d.series = b.series AND d.i = b.i AND d.k = 7 AND d.j = b.i + 8
JOIN ols_fit f ON f.model = b.model AND f.series = b.series WHERE b.k = 7 AND b.j = 7"""


def rolling_system(window: int) -> str:
    """The normal equations of each day's last `window` rows, in long form."""
    sums = [f"sum({a} * {b}) OVER w" for a in _FACTORS for b in (*_FACTORS, "r")]
    return f"""SELECT model, series, DATE, (k - 1) // 8 AS i, (k - 1) % 8 AS j, v FROM (SELECT model, series, DATE, unnest(sums) AS v, generate_subscripts(sums, 1) AS k FROM (
SELECT model, series, DATE, count(*) OVER w AS n, [{', '.join(sums)}] AS sums FROM aligned WINDOW w AS (PARTITION BY model, series ORDER BY DATE ROWS BETWEEN {window - 1} PRECEDING AND CURRENT ROW)) WHERE n = {window})"""


CTES["rolling_system"] = rolling_system(1260)
solved("rolling_solved", "rolling_system", "model, series, DATE", 7)

_ORDER = list(CTES)


def query(body: str) -> str:
    """`body` with the CTEs it names, and those that these name, before it."""
    import re

    need: set[str] = set()

    def visit(text: str) -> None:
        for n in _ORDER:
            if n not in need and re.search(rf"\b(FROM|JOIN|,)\s+{n}\b", text):
                need.add(n)
                visit(CTES[n])

    visit(body)
    done: list[str] = []

    def place(n: str) -> None:
        if n in done:
            return
        for m in _ORDER:
            if m != n and m in need and re.search(rf"\b(FROM|JOIN|,)\s+{m}\b", CTES[n]):
                place(m)
        done.append(n)

    for n in _ORDER:
        if n in need:
            place(n)
    return "WITH RECURSIVE " + ",\n".join(f"{n} AS MATERIALIZED ({CTES[n]})" for n in done) + "\n" + body if done else body
