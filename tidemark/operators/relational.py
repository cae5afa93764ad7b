"""Evaluation, board, joins, risk, attribution, quality and screening operators.

All are DataFrame or SQL plans over the panel. ``QUERIES`` holds those that read the
same in Spark SQL and in an ANSI engine as one text over the views ``panel`` and the
test tables; the few words that differ are written in braces and filled per dialect.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..plans.compile import significant
from ..sources.panel import PANEL_SQL, market_panel

TABLES = ("lineitem", "orders", "supplier", "customer", "part", "nation", "region", "events", "documents", "labels", "conversations")

_W = "PARTITION BY ts_code ORDER BY trade_date"
_RANK = "((rank() OVER (PARTITION BY trade_date ORDER BY {0} NULLS LAST)) + (count({0}) OVER (PARTITION BY trade_date, {0}) - 1) / 2.0D) / count({0}) OVER (PARTITION BY trade_date)"


def _rank(x: str) -> str:
    return _RANK.replace("{0}", x)


def _s(x: str) -> str:
    """Nine decimals and twenty significant bits: equal in all engines."""
    return significant(f"round({x}, 9) + 0.0D")


#: Four-week momentum and the following four-week return, where both exist.
SIGNAL = f"""signal AS (
  SELECT ts_code, trade_date, industry, total_mv, close, f, fwd FROM (
    SELECT ts_code, trade_date, industry, total_mv, close,
           close / lag(close, 4) OVER ({_W}) - 1 AS f, lead(close, 4) OVER ({_W}) / close - 1 AS fwd
    FROM panel) AS x
  WHERE f IS NOT NULL AND fwd IS NOT NULL)"""

CORR = "covar_pop({a}, {b}) / nullif(stddev_pop({a}) * stddev_pop({b}), 0.0D)"


def _corr(a: str, b: str) -> str:
    return CORR.replace("{a}", a).replace("{b}", b)


#: Securities per date below which a date is left out.
MIN_NAMES = 5
GROUPS = 5

RANKED = f"""ranked AS (
  SELECT *, {_rank('f')} AS rf, {_rank('fwd')} AS rr, count(1) OVER (PARTITION BY trade_date) AS n,
         row_number() OVER (PARTITION BY trade_date ORDER BY f, ts_code) AS rn
  FROM signal)"""
GROUPED = f"""grouped AS (
  SELECT *, CAST(least(floor((rn - 1) / greatest(1, floor(n / {GROUPS}.0D))), {GROUPS - 1}) AS INT) AS g
  FROM ranked WHERE n >= {MIN_NAMES})"""
GROUP_RETURNS = "group_returns AS (SELECT trade_date, g, avg(fwd) AS ret, count(1) AS names FROM grouped GROUP BY trade_date, g)"
DATES = "dates AS (SELECT trade_date, row_number() OVER (ORDER BY trade_date) AS i FROM (SELECT DISTINCT trade_date FROM grouped) AS d)"
MARKET = f"""market AS (
  SELECT trade_date, avg(r) AS r FROM (SELECT trade_date, close / lag(close, 1) OVER ({_W}) - 1 AS r FROM panel) AS x
  WHERE r IS NOT NULL GROUP BY trade_date)"""
CURVE = f"curve AS (SELECT trade_date, r, exp(sum(ln(1 + r)) OVER (ORDER BY trade_date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS v FROM market)"
DRAWN = "drawn AS (SELECT trade_date, r, v, max(v) OVER (ORDER BY trade_date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS peak FROM curve)"
DAY = "CAST(trade_date AS STRING) AS trade_date"

QUERIES: dict[str, str] = {
    # evaluation of a factor
    "rank_ic": f"WITH {SIGNAL}, {RANKED} SELECT {DAY}, CAST(max(n) AS BIGINT) AS names, {_s(_corr('rf', 'rr'))} AS ic FROM ranked WHERE n >= {MIN_NAMES} GROUP BY trade_date",
    "board_ic": f"WITH {SIGNAL}, {RANKED} SELECT {DAY}, {_s(_corr('f', 'fwd'))} AS ic FROM ranked WHERE n >= 10 GROUP BY trade_date",
    "ic_summary": f"WITH {SIGNAL}, {RANKED}, ics AS (SELECT trade_date, {_corr('rf', 'rr')} AS ic FROM ranked WHERE n >= {MIN_NAMES} GROUP BY trade_date) SELECT count(ic) AS dates, {_s('avg(ic)')} AS ic_mean, {_s('stddev_samp(ic)')} AS ic_std, {_s('avg(ic) / nullif(stddev_samp(ic), 0.0D)')} AS ir, {_s('avg(CASE WHEN round(ic, 9) > 0 THEN 1.0D ELSE 0.0D END)')} AS positive, {_s('avg(ic) / nullif(stddev_samp(ic), 0.0D) * sqrt(count(ic))')} AS t_stat FROM ics",
    "evaluate_groups": f"""WITH {SIGNAL}, {RANKED}, bounds AS (SELECT *, CAST(floor((rn * {GROUPS} - 1) / n) AS INT) AS g0 FROM ranked WHERE n >= greatest({GROUPS}, 3)),
      grouped AS (SELECT *, CASE WHEN rn > floor((g0 + 1) * n / CAST({GROUPS} AS DOUBLE)) THEN g0 + 1 WHEN rn <= floor(g0 * n / CAST({GROUPS} AS DOUBLE)) THEN g0 - 1 ELSE g0 END AS g FROM bounds)
      SELECT {DAY}, g, count(1) AS names, {_s('avg(fwd)')} AS ret FROM grouped GROUP BY trade_date, g""",
    "group_summary": f"WITH {SIGNAL}, {RANKED}, {GROUPED}, {GROUP_RETURNS} SELECT g, count(1) AS dates, {_s('avg(ret)')} AS mean_ret, {_s('stddev_samp(ret)')} AS std_ret, {_s('exp(sum(ln(1 + ret)) / count(1)) - 1')} AS geometric FROM group_returns GROUP BY g",
    "monotonicity": f"WITH {SIGNAL}, {RANKED}, {GROUPED}, {GROUP_RETURNS}, m AS (SELECT g, avg(ret) AS ret FROM group_returns GROUP BY g) SELECT count(1) AS pairs, sum(CASE WHEN b.ret > a.ret THEN 1 ELSE 0 END) AS rising, {_s('sum(CASE WHEN b.ret > a.ret THEN 1.0D WHEN b.ret < a.ret THEN -1.0D ELSE 0.0D END) / count(1)')} AS score FROM m a JOIN m b ON a.g < b.g",
    "evaluate_turnover": f"""WITH {SIGNAL}, {RANKED}, {GROUPED}, {DATES},
      held AS (SELECT g.ts_code, g.g, d.i FROM grouped g JOIN dates d ON d.trade_date = g.trade_date),
      both_ AS (SELECT a.i, a.g, count(1) AS common FROM held a JOIN held b ON a.ts_code = b.ts_code AND a.g = b.g AND b.i = a.i - 1 GROUP BY a.i, a.g),
      sizes AS (SELECT i, g, count(1) AS n FROM held GROUP BY i, g)
      SELECT CAST(s.i AS BIGINT) AS date_no, s.g, {_s('1 - coalesce(c.common, 0) / CAST(s.n + p.n - coalesce(c.common, 0) AS DOUBLE)')} AS turnover
      FROM sizes s JOIN sizes p ON p.i = s.i - 1 AND p.g = s.g LEFT JOIN both_ c ON c.i = s.i AND c.g = s.g""",
    "longshort_curve": f"""WITH {SIGNAL}, {RANKED}, {GROUPED}, {GROUP_RETURNS},
      ls AS (SELECT trade_date, max(CASE WHEN g = {GROUPS - 1} THEN ret END) - max(CASE WHEN g = 0 THEN ret END) AS spread FROM group_returns GROUP BY trade_date)
      SELECT {DAY}, {_s('spread')} AS spread, {_s('sum(spread) OVER (ORDER BY trade_date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)')} AS total FROM ls""",
    "weight_turnover": f"""WITH {SIGNAL}, {RANKED}, {GROUPED}, {DATES},
      w AS (SELECT g.ts_code, d.i, 1.0D / count(1) OVER (PARTITION BY d.i) AS w FROM grouped g JOIN dates d ON d.trade_date = g.trade_date WHERE g.g = {GROUPS - 1}),
      moves AS (SELECT coalesce(a.i, b.i + 1) AS i, coalesce(a.w, 0.0D) - coalesce(b.w, 0.0D) AS d FROM w a FULL OUTER JOIN w b ON a.ts_code = b.ts_code AND a.i = b.i + 1)
      SELECT CAST(i AS BIGINT) AS date_no, {_s('sum(CASE WHEN d > 0 THEN d ELSE 0.0D END)')} AS bought, {_s('-sum(CASE WHEN d < 0 THEN d ELSE 0.0D END)')} AS sold FROM moves GROUP BY i""",
    "board_quantile_nav": f"""WITH {SIGNAL}, {RANKED}, {GROUPED}, {DATES},
      picks AS (SELECT g.g, g.ts_code, d.i, avg(g.fwd) OVER (PARTITION BY d.i, g.g) AS ret, 1.0D / count(1) OVER (PARTITION BY d.i, g.g) AS w FROM grouped g JOIN dates d ON d.trade_date = g.trade_date WHERE (d.i - 1) % 4 = 0),
      moves AS (SELECT coalesce(a.g, b.g) AS g, coalesce(a.i, b.i + 4) AS i, coalesce(a.w, 0.0D) - coalesce(b.w, 0.0D) AS d, a.ret FROM picks a FULL OUTER JOIN picks b ON a.ts_code = b.ts_code AND a.g = b.g AND a.i = b.i + 4),
      steps AS (SELECT g, i, max(ret) AS ret, sum(CASE WHEN d > 0 THEN d ELSE 0.0D END) AS bought, -sum(CASE WHEN d < 0 THEN d ELSE 0.0D END) AS sold FROM moves GROUP BY g, i),
      net AS (SELECT g, i, ret - (bought * (0.0003D + 0.001D) + sold * (0.0003D + 0.001D + 0.001D)) AS r FROM steps WHERE ret IS NOT NULL)
      SELECT g, CAST(i AS BIGINT) AS date_no, {_s('r')} AS net_ret, {_s('sum(ln(1 + r)) OVER (PARTITION BY g ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)')} AS log_nav FROM net""",
    "ic_decay": f"""WITH hs AS (SELECT 1 AS h UNION ALL SELECT 3 UNION ALL SELECT 5 UNION ALL SELECT 10 UNION ALL SELECT 20),
      idx AS (SELECT ts_code, trade_date, close, close / lag(close, 4) OVER ({_W}) - 1 AS f, row_number() OVER ({_W}) AS i FROM panel),
      x AS (SELECT hs.h, a.trade_date, a.ts_code, a.f, b.close / a.close - 1 AS fwd FROM idx a CROSS JOIN hs JOIN idx b ON b.ts_code = a.ts_code AND b.i = a.i + hs.h WHERE a.f IS NOT NULL),
      k AS (SELECT h, trade_date, {_rank('f').replace('PARTITION BY trade_date', 'PARTITION BY h, trade_date')} AS rf, {_rank('fwd').replace('PARTITION BY trade_date', 'PARTITION BY h, trade_date')} AS rr FROM x),
      ics AS (SELECT h, trade_date, {_corr('rf', 'rr')} AS ic FROM k GROUP BY h, trade_date HAVING count(1) >= {MIN_NAMES})
      SELECT h, count(ic) AS dates, {_s('avg(ic)')} AS ic FROM ics GROUP BY h""",
    "factor_corr": f"""WITH f AS (SELECT ts_code, trade_date, close / lag(close, 4) OVER ({_W}) - 1 AS a, close / lag(close, 12) OVER ({_W}) - 1 AS b, volume AS c FROM panel)
      SELECT {_s(_corr('a', 'b'))} AS ab, {_s(_corr('a', 'c'))} AS ac, {_s(_corr('b', 'c'))} AS bc FROM f WHERE a IS NOT NULL AND b IS NOT NULL""",
    "ic_weights": f"""WITH {SIGNAL}, {RANKED}, ics AS (SELECT substr(CAST(trade_date AS STRING), 1, 4) AS y, {_corr('rf', 'rr')} AS ic FROM ranked WHERE n >= {MIN_NAMES} GROUP BY trade_date), m AS (SELECT y, avg(ic) AS ic FROM ics GROUP BY y) SELECT y, {_s('abs(ic) / sum(abs(ic)) OVER ()')} AS weight FROM m""",
    "mining_segment_metrics": f"""WITH {SIGNAL}, {RANKED}, cut AS (SELECT trade_date, ntile(3) OVER (ORDER BY trade_date) AS segment FROM (SELECT DISTINCT trade_date FROM signal) AS d),
      ics AS (SELECT c.segment, r.trade_date, {_corr('rf', 'rr')} AS ic, avg(CASE WHEN rn > n - greatest(1, floor(n / 5.0D)) THEN fwd END) - avg(CASE WHEN rn <= greatest(1, floor(n / 5.0D)) THEN fwd END) AS spread FROM ranked r JOIN cut c ON c.trade_date = r.trade_date WHERE n >= 4 GROUP BY c.segment, r.trade_date)
      SELECT segment, count(ic) AS dates, {_s('avg(ic)')} AS ic_mean, {_s('avg(ic) / nullif(stddev_samp(ic), 0.0D)')} AS ir, {_s('avg(spread)')} AS spread, {_s('avg(CASE WHEN spread > 0 THEN 1.0D ELSE 0.0D END)')} AS win_rate FROM ics GROUP BY segment""",
    "walk_forward_folds": """WITH d AS (SELECT trade_date, row_number() OVER (ORDER BY trade_date) - 1 AS i FROM (SELECT DISTINCT trade_date FROM panel) AS x),
      f AS (SELECT d.i AS fold FROM d CROSS JOIN (SELECT count(1) AS n FROM d) AS c WHERE d.i * 50 + 200 <= c.n)
      SELECT CAST(f.fold AS INT) AS fold, CASE WHEN d.i < f.fold * 50 + 150 THEN 'train' ELSE 'test' END AS part, count(1) AS dates, CAST(min(d.trade_date) AS STRING) AS first_day, CAST(max(d.trade_date) AS STRING) AS last_day
      FROM f JOIN d ON d.i >= f.fold * 50 AND d.i < f.fold * 50 + 200 AND NOT (d.i >= f.fold * 50 + 145 AND d.i < f.fold * 50 + 150) GROUP BY 1, 2""",
    # cross-sectional preprocessing
    "xs_ols_neutral": f"""WITH x AS (SELECT ts_code, trade_date, industry, volume AS y, ln(total_mv) AS m FROM panel),
      d AS (SELECT *, y - avg(y) OVER (PARTITION BY trade_date, industry) AS yd, m - avg(m) OVER (PARTITION BY trade_date, industry) AS md, count(1) OVER (PARTITION BY trade_date) AS n FROM x)
      SELECT ts_code, {DAY}, {_s('yd - md * coalesce(sum(yd * md) OVER (PARTITION BY trade_date) / nullif(round(sum(md * md) OVER (PARTITION BY trade_date), 12), 0.0D), 0.0D)')} AS residual FROM d WHERE n >= 5""",
    # joins
    "asof_membership": f"""WITH snaps AS (SELECT DISTINCT ts_code, CAST(date_trunc('quarter', trade_date) AS DATE) AS snap FROM panel),
      spans AS (SELECT snap, row_number() OVER (ORDER BY snap) AS k, lead(snap) OVER (ORDER BY snap) AS nxt FROM (SELECT DISTINCT snap FROM snaps) AS s)
      SELECT {DAY.replace('trade_date AS STRING', 'p.trade_date AS STRING')}, count(1) AS members FROM panel p
      JOIN spans s ON (p.trade_date >= s.snap OR s.k = 1) AND (p.trade_date < s.nxt OR s.nxt IS NULL) JOIN snaps m ON m.snap = s.snap AND m.ts_code = p.ts_code GROUP BY p.trade_date""",
    "asof_ffill": f"""WITH b AS (SELECT ts_code, trade_date, CASE WHEN CAST(volume AS BIGINT) % 3 = 0 THEN turnover_rate END AS t FROM panel),
      g AS (SELECT *, count(t) OVER ({_W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS k FROM b)
      SELECT ts_code, {DAY}, {_s('max(t) OVER (PARTITION BY ts_code, k)')} AS filled FROM g""",
    "adjusted_prices": f"""WITH a AS (SELECT ts_code, trade_date, close, 1 + row_number() OVER ({_W}) / 100.0D AS adj FROM panel),
      l AS (SELECT *, max(adj) OVER (PARTITION BY ts_code) AS newest FROM a) SELECT ts_code, {DAY}, {_s('close * adj / newest')} AS qfq FROM l""",
    "calendar_gaps": f"""WITH c AS (SELECT DISTINCT trade_date FROM panel), k AS (SELECT ts_code, min(trade_date) AS lo, max(trade_date) AS hi FROM panel GROUP BY ts_code),
      want AS (SELECT k.ts_code, c.trade_date, row_number() OVER (PARTITION BY k.ts_code ORDER BY c.trade_date) AS i FROM k JOIN c ON c.trade_date BETWEEN k.lo AND k.hi),
      gone AS (SELECT w.ts_code, w.trade_date, w.i - row_number() OVER (PARTITION BY w.ts_code ORDER BY w.trade_date) AS island FROM want w LEFT JOIN panel p ON p.ts_code = w.ts_code AND p.trade_date = w.trade_date WHERE p.ts_code IS NULL)
      SELECT ts_code, CAST(min(trade_date) AS STRING) AS first_day, CAST(max(trade_date) AS STRING) AS last_day, count(1) AS days FROM gone GROUP BY ts_code, island""",
    "parity_diff": """WITH a AS (SELECT ts_code, trade_date, volume FROM panel WHERE CAST(volume AS BIGINT) % 7 <> 0), b AS (SELECT ts_code, trade_date, volume FROM panel WHERE CAST(volume AS BIGINT) % 5 <> 0)
      SELECT CAST(coalesce(a.trade_date, b.trade_date) AS STRING) AS trade_date, sum(CASE WHEN b.ts_code IS NULL THEN 1 ELSE 0 END) AS only_left, sum(CASE WHEN a.ts_code IS NULL THEN 1 ELSE 0 END) AS only_right
      FROM a FULL OUTER JOIN b ON a.ts_code = b.ts_code AND a.trade_date = b.trade_date GROUP BY 1""",
    # risk, metrics, attribution, portfolio
    "metrics": f"""WITH {MARKET}, {CURVE}, {DRAWN}, s AS (SELECT count(1) AS n, sum(ln(1 + r)) AS lg, avg(r) AS mu, stddev_samp(r) AS sd, stddev_samp(CASE WHEN r < 0.03D / 52 THEN r - 0.03D / 52 END) AS down, min((v - peak) / peak) AS dd, avg(CASE WHEN r > 0 THEN 1.0D ELSE 0.0D END) AS win FROM drawn)
      SELECT n, {_s('lg')} AS log_total, {_s('lg * 52 / n')} AS log_annual, {_s('sd * sqrt(52.0D)')} AS vol, {_s('(mu - 0.03D / 52) / sd * sqrt(52.0D)')} AS sharpe, {_s('(mu - 0.03D / 52) / down * sqrt(52.0D)')} AS sortino, {_s('dd')} AS max_drawdown, {_s('win')} AS win_rate FROM s""",
    "alpha_beta": f"""WITH {MARKET}, x AS (SELECT p.ts_code, p.r, m.r AS b FROM (SELECT ts_code, trade_date, close / lag(close, 1) OVER ({_W}) - 1 AS r FROM panel) p JOIN market m ON m.trade_date = p.trade_date WHERE p.r IS NOT NULL)
      SELECT ts_code, {_s('covar_samp(r, b) / nullif(var_samp(b), 0.0D)')} AS beta, {_s('avg(r) - covar_samp(r, b) / nullif(var_samp(b), 0.0D) * avg(b)')} AS alpha, {_s('avg(r - b) / nullif(stddev_samp(r - b), 0.0D)')} AS ir FROM x GROUP BY ts_code""",
    # the next peak of an episode's security is its recovery; it is read before shallow episodes leave
    "drawdown_episodes": f"""WITH x AS (SELECT ts_code, trade_date, close, max(close) OVER ({_W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS peak FROM panel),
      e AS (SELECT *, (close - peak) / peak AS dd, sum(CASE WHEN close >= peak THEN 1 ELSE 0 END) OVER ({_W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS k, row_number() OVER ({_W}) AS i FROM x),
      g AS (SELECT ts_code, k, min(trade_date) AS peak_day, min(CASE WHEN dd < 0 THEN trade_date END) AS start_day, min_by(trade_date, dd) AS trough_day, min(dd) AS depth, count(1) - 1 AS days FROM e GROUP BY ts_code, k),
      h AS (SELECT *, lead(peak_day) OVER (PARTITION BY ts_code ORDER BY k) AS recovery FROM g)
      SELECT ts_code, CAST(start_day AS STRING) AS start_day, CAST(trough_day AS STRING) AS trough_day, CAST(recovery AS STRING) AS recovery_day, days, {_s('depth')} AS depth FROM h WHERE depth <= -0.02D""",
    "underwater": f"WITH {MARKET}, {CURVE}, {DRAWN} SELECT {DAY}, {_s('(v - peak) / peak')} AS underwater FROM drawn",
    "monthly_returns": f"WITH x AS (SELECT ts_code, substr(CAST(trade_date AS STRING), 1, 7) AS month, trade_date, close FROM panel) SELECT ts_code, month, {_s('max_by(close, trade_date) / min_by(close, trade_date) - 1')} AS ret FROM x GROUP BY ts_code, month",
    "var_cvar": f"WITH {MARKET}, o AS (SELECT r, row_number() OVER (ORDER BY r) - 1 AS i, count(1) OVER () AS n FROM market) SELECT {_s('max(CASE WHEN i = floor(0.05D * n) THEN r END)')} AS var_5, {_s('avg(CASE WHEN i < greatest(floor(0.05D * n), 1) THEN r END)')} AS cvar_5 FROM o",
    "moments": f"WITH {MARKET}, m AS (SELECT avg(r) AS mu, stddev_samp(r) AS sd, count(1) AS n FROM market), z AS (SELECT n, power((r - mu) / sd, 3) AS z3, power((r - mu) / sd, 4) AS z4 FROM market CROSS JOIN m) SELECT {_s('avg(z3)')} AS skew_z, {_s('avg(z4) - 3')} AS kurt_z, {_s('max(n) / 6.0D * (avg(z3) * avg(z3) + (avg(z4) - 3) * (avg(z4) - 3) / 4)')} AS jarque_bera FROM z",
    "histogram50": f"WITH {MARKET}, b AS (SELECT r, min(r) OVER () AS lo, max(r) OVER () AS hi FROM market) SELECT CAST(least(floor((r - lo) / (hi - lo) * 50), 49) AS INT) AS bin, count(1) AS n FROM b GROUP BY 1",
    "rolling_risk": f"WITH {MARKET}, w AS (SELECT trade_date, count(1) OVER (ORDER BY trade_date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS n, stddev_samp(r) OVER (ORDER BY trade_date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS sd, avg(r) OVER (ORDER BY trade_date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS mu FROM market) SELECT {DAY}, {_s('sd * sqrt(52.0D)')} AS vol, {_s('mu / sd * sqrt(52.0D)')} AS sharpe FROM w WHERE n = 20",
    "sector_attr": f"""WITH r AS (SELECT ts_code, trade_date, industry, close / lag(close, 1) OVER ({_W}) - 1 AS r, lag(amount, 1) OVER ({_W}) AS w FROM panel),
      s AS (SELECT trade_date, industry, sum(w * r) / sum(w) AS rp, avg(r) AS rb, sum(w) AS w, count(1) AS k FROM r WHERE r IS NOT NULL GROUP BY trade_date, industry),
      t AS (SELECT *, w / sum(w) OVER (PARTITION BY trade_date) AS wp, CAST(k AS DOUBLE) / sum(k) OVER (PARTITION BY trade_date) AS wb, avg(rb) OVER (PARTITION BY trade_date) AS total FROM s)
      SELECT industry, {_s('avg((wp - wb) * (rb - total))')} AS allocation, {_s('avg(wb * (rp - rb))')} AS selection, {_s('avg((wp - wb) * (rp - rb))')} AS interaction FROM t GROUP BY industry""",
    "corr_matrix": f"""WITH r AS (SELECT ts_code, trade_date, close / lag(close, 1) OVER ({_W}) - 1 AS r FROM panel)
      SELECT a.ts_code AS x, b.ts_code AS y, count(1) AS days, {_s(_corr('a.r', 'b.r'))} AS c FROM r a JOIN r b ON a.trade_date = b.trade_date AND a.ts_code < b.ts_code WHERE a.r IS NOT NULL AND b.r IS NOT NULL GROUP BY 1, 2 HAVING count(1) >= 20""",
    "portfolio_sim": f"""WITH r AS (SELECT ts_code, trade_date, close / lag(close, 1) OVER ({_W}) - 1 AS r FROM panel), v AS (SELECT ts_code, 1 / var_samp(r) AS iv FROM r GROUP BY ts_code), w AS (SELECT ts_code, iv / total AS w FROM v CROSS JOIN (SELECT sum(iv) AS total FROM v) AS t),
      d AS (SELECT r.trade_date, sum(w.w * r.r) AS r FROM r JOIN w ON w.ts_code = r.ts_code WHERE r.r IS NOT NULL GROUP BY r.trade_date)
      SELECT {DAY}, {_s('r')} AS r, {_s('sum(ln(1 + r)) OVER (ORDER BY trade_date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)')} AS log_value FROM d""",
    # data quality
    "quality_missing": """WITH c AS (SELECT count(DISTINCT trade_date) AS days FROM panel) SELECT ts_code, CAST(max(days) - count(1) AS BIGINT) AS missing, CASE WHEN max(days) - count(1) > 0.3D * max(days) THEN 'error' WHEN max(days) - count(1) > 0.05D * max(days) THEN 'warning' ELSE 'clean' END AS status FROM panel CROSS JOIN c GROUP BY ts_code""",
    "quality_extremes": f"SELECT ts_code, count(1) AS days FROM (SELECT ts_code, close / lag(close, 1) OVER ({_W}) - 1 AS r FROM panel) AS x WHERE abs(r) > 0.11D GROUP BY ts_code",
    "quality_suspension": "SELECT ts_code, sum(CASE WHEN open = close AND high = low AND open = high THEN 1 ELSE 0 END) AS flat, sum(CASE WHEN volume = 0 THEN 1 ELSE 0 END) AS no_volume FROM panel GROUP BY ts_code",
    "quality_sticking": f"""WITH x AS (SELECT ts_code, trade_date, CASE WHEN close = lag(close, 1) OVER ({_W}) THEN 0 ELSE 1 END AS new FROM panel),
      g AS (SELECT *, sum(new) OVER ({_W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS k FROM x),
      m AS (SELECT ts_code, max(n) AS longest FROM (SELECT ts_code, k, count(1) AS n FROM g GROUP BY ts_code, k) AS y GROUP BY ts_code)
      SELECT ts_code, longest, CASE WHEN longest >= 5 THEN 'warning' ELSE 'clean' END AS status FROM m""",
    "quality_freshness": """WITH e AS (SELECT max(trade_date) AS d FROM panel), l AS (SELECT ts_code, max(trade_date) AS last_ FROM panel GROUP BY ts_code),
      g AS (SELECT ts_code, CAST(last_ AS STRING) AS last_day, CAST(replace(substr(CAST(d AS STRING), 1, 10), '-', '') AS INT) - CAST(replace(substr(CAST(last_ AS STRING), 1, 10), '-', '') AS INT) AS gap FROM l CROSS JOIN e)
      SELECT ts_code, last_day, gap, CASE WHEN gap > 100 THEN 'error' WHEN gap > 10 THEN 'warning' ELSE 'clean' END AS status FROM g""",
    # top-k, screening, set operations
    "top_bottom_pct": f"WITH {SIGNAL}, {RANKED} SELECT {DAY}, ts_code, CASE WHEN rn <= greatest(1, floor(n * 0.1D)) THEN 'bottom' ELSE 'top' END AS side FROM ranked WHERE rn <= greatest(1, floor(n * 0.1D)) OR rn > n - greatest(1, floor(n * 0.1D))",
    "top_holdings": f"SELECT {DAY}, ts_code, CAST(k AS INT) AS k FROM (SELECT trade_date, ts_code, row_number() OVER (PARTITION BY trade_date ORDER BY amount DESC, ts_code) AS k FROM panel) AS x WHERE k <= 10",
    "last_rows": f"SELECT ts_code, {DAY}, close FROM (SELECT *, row_number() OVER (PARTITION BY ts_code ORDER BY trade_date DESC) AS k FROM panel) AS x WHERE k <= 5",
    "curve_downsample": f"WITH {MARKET}, {CURVE}, n AS (SELECT trade_date, v, row_number() OVER (ORDER BY trade_date) AS i, count(1) OVER () AS n FROM curve) SELECT {DAY}, {_s('v')} AS v FROM n WHERE (i - 1) % CAST(ceil(n / 260.0D) AS BIGINT) = 0 OR i = n",
    "universe_filter": "SELECT ts_code, count(1) AS days FROM panel WHERE ts_code NOT LIKE '00001%' AND industry IN ('N1', 'N2', 'N3', 'N4', 'N5') GROUP BY ts_code",
    "set_operations": "SELECT 'both' AS kind, count(1) AS n FROM (SELECT ts_code FROM panel WHERE volume > 60 INTERSECT SELECT ts_code FROM panel WHERE volume < 10) AS a UNION ALL SELECT 'first', count(1) FROM (SELECT ts_code FROM panel WHERE volume > 60 EXCEPT SELECT ts_code FROM panel WHERE volume < 10) AS b",
    "piotroski": f"""WITH q AS (SELECT ts_code, substr(CAST(trade_date AS STRING), 1, 4) AS y, round(avg(pe), 9) AS roe, round(avg(close - open) / avg(close), 9) AS roa, round(sum(CASE WHEN close > open THEN amount ELSE 0 END) / sum(amount), 9) AS ocf, round(avg(high - close) / avg(high), 9) AS npm, round(avg(pb), 9) AS debt, round(sum(volume) / count(1), 9) AS cur, round(avg(high - low) / avg(high), 9) AS gm, round(avg(turnover_rate), 9) AS turns FROM panel GROUP BY 1, 2),
      l AS (SELECT *, lag(roa) OVER ({{w}}) AS roa0, lag(debt) OVER ({{w}}) AS debt0, lag(cur) OVER ({{w}}) AS cur0, lag(gm) OVER ({{w}}) AS gm0, lag(turns) OVER ({{w}}) AS turns0, row_number() OVER (PARTITION BY ts_code ORDER BY y DESC) AS k, count(1) OVER (PARTITION BY ts_code) AS reports FROM q),
      p AS (SELECT ts_code, reports, (CASE WHEN roa > 0 THEN 1 ELSE 0 END) + (CASE WHEN ocf > 0 THEN 1 ELSE 0 END) + (CASE WHEN roa > roa0 THEN 1 ELSE 0 END) + (CASE WHEN ocf > npm THEN 1 ELSE 0 END) + (CASE WHEN debt < debt0 THEN 1 ELSE 0 END) + (CASE WHEN cur > cur0 THEN 1 ELSE 0 END) + (CASE WHEN gm > gm0 THEN 1 ELSE 0 END) + (CASE WHEN turns > turns0 THEN 1 ELSE 0 END) + (CASE WHEN roe > 8 THEN 1 ELSE 0 END) AS raw_score FROM l WHERE k = 1)
      SELECT ts_code, raw_score, round(raw_score / 9.0D * 100, 1) AS score FROM p WHERE reports >= 2""".replace("{{w}}", "PARTITION BY ts_code ORDER BY y").replace("{w}", "PARTITION BY ts_code ORDER BY y"),
    # strategy signals
    "signal_ma_cross": f"WITH a AS (SELECT ts_code, trade_date, avg(close) OVER ({_W} ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS s, avg(close) OVER ({_W} ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS l, count(1) OVER ({_W} ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS n FROM panel), b AS (SELECT *, lag(s) OVER ({_W}) AS s0, lag(l) OVER ({_W}) AS l0 FROM a) SELECT ts_code, {DAY}, CASE WHEN s > l AND s0 <= l0 THEN 'buy' WHEN s < l AND s0 >= l0 THEN 'sell' END AS side FROM b WHERE n = 20 AND (s > l AND s0 <= l0 OR s < l AND s0 >= l0)",
    "signal_turtle": f"WITH a AS (SELECT ts_code, trade_date, close, max(high) OVER ({_W} ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS hi, min(low) OVER ({_W} ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) AS lo, count(1) OVER ({_W} ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS n FROM panel) SELECT ts_code, {DAY}, CASE WHEN close > hi THEN 'buy' ELSE 'sell' END AS side FROM a WHERE n = 20 AND (close > hi OR close < lo)",
    "signal_mean_reversion": f"WITH a AS (SELECT ts_code, trade_date, (close - avg(close) OVER ({_W} ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)) / stddev_samp(close) OVER ({_W} ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS z, count(1) OVER ({_W} ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS n FROM panel) SELECT ts_code, {DAY}, {_s('z')} AS z, CASE WHEN z < -1 THEN 'buy' WHEN z > 0 THEN 'sell' ELSE 'hold' END AS side FROM a WHERE n = 20",
    "signal_bollinger": f"WITH a AS (SELECT ts_code, trade_date, close, avg(close) OVER ({_W} ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS m, stddev_samp(close) OVER ({_W} ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS sd, count(1) OVER ({_W} ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS n FROM panel) SELECT ts_code, {DAY}, CASE WHEN close > m + 2 * sd THEN 'buy' ELSE 'sell' END AS side FROM a WHERE n = 20 AND (close > m + 2 * sd OR close < m)",
    "price_limits": f"""WITH x AS (SELECT ts_code, trade_date, open, lag(close, 1) OVER ({_W}) AS prev, CASE WHEN CAST(substr(ts_code, 5, 2) AS INT) % 10 = 7 THEN 5 WHEN CAST(substr(ts_code, 5, 2) AS INT) % 10 = 3 THEN 20 ELSE 10 END AS pct FROM panel)
      SELECT ts_code, {DAY}, pct, CAST(floor(prev * (100 + pct) / 100 + 0.5D) AS DOUBLE) AS up_limit, CAST(floor(prev * (100 - pct) / 100 + 0.5D) AS DOUBLE) AS down_limit, open >= floor(prev * (100 + pct) / 100 + 0.5D) AS buy_blocked, open <= floor(prev * (100 - pct) / 100 + 0.5D) AS sell_blocked FROM x WHERE prev IS NOT NULL""",
    "trading_costs": f"SELECT ts_code, {DAY}, {_s('greatest(amount / 100 * 0.0003D, 5.0D)')} AS commission, {_s('amount / 100 * 0.001D')} AS stamp_tax, {_s('amount / 100 * 0.00002D')} AS transfer_fee, {_s('volume * 0.002D')} AS slippage FROM panel",
    # sentiment of texts, bars from ticks
    "sentiment_by_source": "WITH s AS (SELECT source, lang, (CASE WHEN contains(lower(text), 'the') THEN 1 ELSE 0 END) - (CASE WHEN contains(lower(text), 'idiot') OR contains(lower(text), 'scum') THEN 2 ELSE 0 END) AS score FROM documents) SELECT source, lang, count(1) AS texts, CAST(sum(score) AS BIGINT) AS total, sum(CASE WHEN score > 0 THEN 1 ELSE 0 END) AS positive, sum(CASE WHEN score < 0 THEN 1 ELSE 0 END) AS negative FROM s GROUP BY source, lang",
    "bars_hourly": "SELECT event_type, CAST(date_trunc('hour', ts) AS STRING) AS hour_, min_by(value, event_id) AS first_value_, max(value) AS high, min(value) AS low, count(1) AS ticks FROM events GROUP BY 1, 2",
    "batch_summary": "SELECT industry, count(DISTINCT ts_code) AS codes, CAST(min(trade_date) AS STRING) AS first_day, CAST(max(trade_date) AS STRING) AS last_day, max(close) AS high FROM panel GROUP BY industry",
    "board_groups": f"WITH {SIGNAL}, {RANKED}, {GROUPED}, {GROUP_RETURNS} SELECT {DAY}, g, names, {_s('ret')} AS ret FROM group_returns",
    "evaluate_rank_ic": f"WITH {SIGNAL}, {RANKED} SELECT {DAY}, CAST(max(n) AS BIGINT) AS names, round({_s('coalesce(' + _corr('rf', 'rr') + ', 0.0D)')}, 4) AS ic FROM ranked WHERE n >= greatest({GROUPS}, 3) GROUP BY trade_date",
    "quality_issues": f"""WITH p AS (SELECT *, lag(close, 1) OVER ({_W}) AS prev FROM panel), e AS (SELECT max(trade_date) AS d, count(DISTINCT trade_date) AS days FROM panel),
      runs AS (SELECT ts_code, trade_date, sum(CASE WHEN close = prev THEN 0 ELSE 1 END) OVER ({_W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS k FROM p),
      stick AS (SELECT ts_code, max(n) AS n FROM (SELECT ts_code, k, count(1) AS n FROM runs GROUP BY ts_code, k) AS y GROUP BY ts_code),
      c AS (SELECT ts_code, max(e.days) - count(1) AS missing, max(e.days) AS days, sum(CASE WHEN open = high AND high = low AND low = close THEN 1 ELSE 0 END) AS flat, sum(CASE WHEN volume = 0 AND close <> prev THEN 1 ELSE 0 END) AS moved, sum(CASE WHEN abs(close / prev - 1) > 0.11D THEN 1 ELSE 0 END) AS extreme,
            CAST(replace(substr(CAST(max(e.d) AS STRING), 1, 10), '-', '') AS INT) - CAST(replace(substr(CAST(max(p.trade_date) AS STRING), 1, 10), '-', '') AS INT) AS gap FROM p CROSS JOIN e GROUP BY ts_code),
      issues AS (
        SELECT ts_code, 'missing_dates' AS kind, CASE WHEN missing > 0.3D * days THEN 2 WHEN missing > 0.05D * days THEN 1 ELSE 0 END AS severity, missing AS n FROM c
        UNION ALL SELECT ts_code, 'suspension', CASE WHEN flat >= 10 THEN 2 WHEN flat >= 1 THEN 1 ELSE 0 END, flat FROM c
        UNION ALL SELECT ts_code, 'zero_volume', CASE WHEN moved > 0 THEN 1 ELSE 0 END, moved FROM c
        UNION ALL SELECT ts_code, 'extreme_return', CASE WHEN extreme >= 5 THEN 2 WHEN extreme > 0 THEN 1 ELSE 0 END, extreme FROM c
        UNION ALL SELECT ts_code, 'price_sticking', CASE WHEN n >= 5 THEN 1 ELSE 0 END, n FROM stick
        UNION ALL SELECT ts_code, 'stale_data', CASE WHEN gap > 100 THEN 2 WHEN gap > 10 THEN 1 ELSE 0 END, gap FROM c)
      SELECT ts_code, kind, CASE severity WHEN 2 THEN 'error' ELSE 'warning' END AS severity, CAST(n AS BIGINT) AS n FROM issues WHERE severity > 0""",
    "quality_status": f"""WITH p AS (SELECT *, lag(close, 1) OVER ({_W}) AS prev FROM panel), e AS (SELECT max(trade_date) AS d, count(DISTINCT trade_date) AS days FROM panel),
      runs AS (SELECT ts_code, trade_date, sum(CASE WHEN close = prev THEN 0 ELSE 1 END) OVER ({_W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS k FROM p),
      stick AS (SELECT ts_code, max(n) AS n FROM (SELECT ts_code, k, count(1) AS n FROM runs GROUP BY ts_code, k) AS y GROUP BY ts_code),
      c AS (SELECT ts_code, max(e.days) - count(1) AS missing, max(e.days) AS days, sum(CASE WHEN open = high AND high = low AND low = close THEN 1 ELSE 0 END) AS flat, sum(CASE WHEN volume = 0 AND close <> prev THEN 1 ELSE 0 END) AS moved, sum(CASE WHEN abs(close / prev - 1) > 0.11D THEN 1 ELSE 0 END) AS extreme,
            CAST(replace(substr(CAST(max(e.d) AS STRING), 1, 10), '-', '') AS INT) - CAST(replace(substr(CAST(max(p.trade_date) AS STRING), 1, 10), '-', '') AS INT) AS gap FROM p CROSS JOIN e GROUP BY ts_code),
      issues AS (
        SELECT ts_code, 'missing_dates' AS kind, CASE WHEN missing > 0.3D * days THEN 2 WHEN missing > 0.05D * days THEN 1 ELSE 0 END AS severity, missing AS n FROM c
        UNION ALL SELECT ts_code, 'suspension', CASE WHEN flat >= 10 THEN 2 WHEN flat >= 1 THEN 1 ELSE 0 END, flat FROM c
        UNION ALL SELECT ts_code, 'zero_volume', CASE WHEN moved > 0 THEN 1 ELSE 0 END, moved FROM c
        UNION ALL SELECT ts_code, 'extreme_return', CASE WHEN extreme >= 5 THEN 2 WHEN extreme > 0 THEN 1 ELSE 0 END, extreme FROM c
        UNION ALL SELECT ts_code, 'price_sticking', CASE WHEN n >= 5 THEN 1 ELSE 0 END, n FROM stick
        UNION ALL SELECT ts_code, 'stale_data', CASE WHEN gap > 100 THEN 2 WHEN gap > 10 THEN 1 ELSE 0 END, gap FROM c)
      SELECT ts_code, CASE max(severity) WHEN 2 THEN 'error' WHEN 1 THEN 'warning' ELSE 'clean' END AS status, CASE max(severity) WHEN 2 THEN 'remove' WHEN 1 THEN 'check before use' END AS recommendation FROM issues GROUP BY ts_code""",
    "quality_zero_volume": f"SELECT ts_code, CAST(sum(CASE WHEN volume = 0 AND close <> prev THEN 1 ELSE 0 END) AS BIGINT) AS moved FROM (SELECT *, lag(close, 1) OVER ({_W}) AS prev FROM panel) AS x GROUP BY ts_code",
    "drawdown_duration": f"""WITH x AS (SELECT ts_code, trade_date, CASE WHEN close >= max(close) OVER ({_W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) THEN 1 ELSE 0 END AS top FROM panel),
      g AS (SELECT ts_code, sum(top) OVER ({_W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS k FROM x) SELECT ts_code, max(n) AS longest FROM (SELECT ts_code, k, count(1) - 1 AS n FROM g GROUP BY ts_code, k) AS y GROUP BY ts_code""",
    "monthly_excess": f"""WITH {MARKET}, b AS (SELECT substr(CAST(trade_date AS STRING), 1, 7) AS month, exp(sum(ln(1 + r))) - 1 AS bench FROM market GROUP BY 1),
      x AS (SELECT p.ts_code, substr(CAST(p.trade_date AS STRING), 1, 7) AS month, max_by(p.close, p.trade_date) / min_by(p.close, p.trade_date) - 1 AS ret FROM panel p GROUP BY 1, 2)
      SELECT x.ts_code, x.month, {_s('x.ret')} AS ret, {_s('b.bench')} AS bench, {_s('x.ret - b.bench')} AS excess FROM x LEFT JOIN b ON b.month = x.month""",
    "annual_returns": "SELECT ts_code, CAST(substr(CAST(trade_date AS STRING), 1, 4) AS INT) AS y, round(max_by(close, trade_date) / min_by(close, trade_date) - 1, 6) AS ret FROM panel GROUP BY 1, 2",
    "rolling_market_corr": f"""WITH {MARKET}, x AS (SELECT p.ts_code, p.trade_date, p.r, m.r AS b FROM (SELECT ts_code, trade_date, close / lag(close, 1) OVER ({_W}) - 1 AS r FROM panel) AS p JOIN market m ON m.trade_date = p.trade_date WHERE p.r IS NOT NULL),
      w AS (SELECT *, count(1) OVER ({_W} ROWS BETWEEN 59 PRECEDING AND CURRENT ROW) AS n, covar_pop(r, b) OVER ({_W} ROWS BETWEEN 59 PRECEDING AND CURRENT ROW) AS c, stddev_pop(r) OVER ({_W} ROWS BETWEEN 59 PRECEDING AND CURRENT ROW) AS sr, stddev_pop(b) OVER ({_W} ROWS BETWEEN 59 PRECEDING AND CURRENT ROW) AS sb FROM x)
      SELECT ts_code, {DAY}, {_s('CASE WHEN sr * sb > 1e-12 THEN c / (sr * sb) ELSE 0.0D END')} AS corr FROM w WHERE n = 60""",
    "factor_decay_windows": f"""WITH {SIGNAL}, {RANKED}, ics AS (SELECT trade_date, {_corr('rf', 'rr')} AS ic FROM ranked WHERE n >= {MIN_NAMES} GROUP BY trade_date),
      lo AS (SELECT min(trade_date) AS d FROM ics), x AS (SELECT ic, datediff(trade_date, lo.d) AS i FROM ics CROSS JOIN lo),
      s AS (SELECT 0 AS k UNION ALL SELECT 1)
      SELECT CAST(floor(i / 30.0D) - k AS INT) AS window_, count(ic) AS dates, {_s('avg(ic)')} AS ic, {_s('avg(ic) / nullif(stddev_samp(ic), 0.0D)')} AS ir FROM x CROSS JOIN s WHERE floor(i / 30.0D) - k >= 0 GROUP BY 1""",
    "fundamentals_on_date": """WITH d AS (SELECT max(trade_date) AS d FROM panel WHERE trade_date <= CAST('1996-03-08' AS DATE) AND trade_date > CAST('1996-02-27' AS DATE)) SELECT ts_code, CAST(trade_date AS STRING) AS trade_date, round(pe, 6) AS pe, round(pb, 6) AS pb, turnover_rate FROM panel p JOIN d ON d.d = p.trade_date""",
    "cross_section_topn": f"""WITH l AS (SELECT ts_code, max_by(close, trade_date) / min_by(close, trade_date) - 1 AS v, max(trade_date) AS last_ FROM panel WHERE trade_date <= CAST('1996-06-30' AS DATE) AND trade_date > CAST('1995-05-07' AS DATE) GROUP BY ts_code),
      k AS (SELECT *, row_number() OVER (ORDER BY v DESC, ts_code) AS top, row_number() OVER (ORDER BY v, ts_code) AS low FROM l)
      SELECT ts_code, CAST(last_ AS STRING) AS last_day, {_s('v')} AS v, CASE WHEN top <= 10 THEN 'top' ELSE 'bottom' END AS side, CAST(least(top, low) AS INT) AS k FROM k WHERE top <= 10 OR low <= 10""",
}


def to_spark(text: str) -> str:
    """Of equal values Spark's min_by keeps the last row and the ANSI engine's the first: the day settles it."""
    import re

    return re.sub(r"\bmin_by\(trade_date, (\w+)\)", r"min_by(trade_date, struct(\1, trade_date))", text)


def run(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """A statement over the view ``panel`` and whichever test tables it names."""
    import re

    text, names = to_spark(text), {}
    if re.search(r"\bpanel\b", text):
        names["panel"] = market_panel(spark, sf_dir)
    for t in TABLES:
        if re.search(rf"\bFROM {t}\b|\bJOIN {t}\b", text):
            names[t] = spark.read.parquet(f"{sf_dir}/{t}.parquet")
    for n, df in names.items():
        text = re.sub(rf"\b(FROM|JOIN) {n}\b", rf"\1 {{{n}}}", text)
    return spark.sql(text, **names) if names else spark.sql(text)


def to_duck(text: str) -> str:
    import re

    text = re.sub(r"(\d)D\b", r"\1::DOUBLE", text)
    text = re.sub(r"\bdatediff\((\S+), (\S+)\)", r"date_diff('day', \2, \1)", text)
    if re.search(r"\bpanel\b", text):
        text = re.sub(r"^\s*(WITH )?", lambda m: f"WITH panel AS ({PANEL_SQL}){', ' if m[1] else ' '}", text, count=1)
    return text


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: (lambda spark, sf_dir, t=t: run(spark, sf_dir, t)) for k, t in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: to_duck(t) for k, t in QUERIES.items()}
