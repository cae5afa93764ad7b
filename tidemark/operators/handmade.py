"""Oracles written by hand for queries whose plans are not SQL: they share no text with them."""

from __future__ import annotations

from ..plans.compile import significant
from ..sources.panel import PANEL_SQL


def _num(x: str, name: str) -> str:
    return f"{significant(f'round({x}, 9) + 0.0::DOUBLE')} AS {name}"


METRICS_FULL = f"""WITH p AS (SELECT ts_code, trade_date, close FROM ({PANEL_SQL})),
  q AS (SELECT ts_code, trade_date, close / lag(close) OVER w - 1 AS r, close / first_value(close) OVER w AS v FROM p WINDOW w AS (PARTITION BY ts_code ORDER BY trade_date)),
  m AS (SELECT trade_date, avg(r) AS b FROM q WHERE r IS NOT NULL GROUP BY trade_date),
  x AS (SELECT q.ts_code, q.trade_date, r, v, b, v / max(v) OVER (PARTITION BY ts_code ORDER BY q.trade_date) - 1 AS dd FROM q JOIN m ON m.trade_date = q.trade_date WHERE r IS NOT NULL),
  t AS (SELECT *, count(*) FILTER (dd >= 0) OVER (PARTITION BY ts_code ORDER BY trade_date) AS peak FROM x),
  u AS (SELECT *, count(*) FILTER (dd < 0) OVER (PARTITION BY ts_code, peak ORDER BY trade_date) AS under FROM t),
  s AS (SELECT ts_code, count(*) AS n, arg_max(v, trade_date) AS last_, avg(r) AS mu, coalesce(stddev_samp(r), 0) AS sd, least(min(dd), 0) AS low, max(under) AS longest,
          coalesce(stddev_samp(r - 0.03::DOUBLE / 52) FILTER (r < 0.03::DOUBLE / 52), 0) AS down, count(*) FILTER (r > 0) / count(*)::DOUBLE AS win, avg(r) FILTER (r > 0) AS gain, -avg(r) FILTER (r < 0) AS loss,
          avg(b) AS mb, CASE WHEN var_samp(b) > 1e-12 THEN covar_samp(r, b) / var_samp(b) ELSE 0 END AS beta, coalesce(stddev_samp(r - b), 0) AS te FROM u GROUP BY ts_code),
  y AS (SELECT *, CASE WHEN last_ > 0 THEN power(last_, 52.0::DOUBLE / n) - 1 ELSE 0 END AS a, 0.03::DOUBLE / 52 AS rf FROM s)
  SELECT ts_code, round((last_ - 1) * 100, 2) AS total_return, round(a * 100, 2) AS annual_return, round(sd * sqrt(52.0::DOUBLE) * 100, 2) AS annual_volatility,
    round(CASE WHEN sd > 1e-12 THEN (mu - rf) / sd ELSE 0 END * sqrt(52.0::DOUBLE), 4) AS sharpe_ratio, round(low * 100, 2) AS max_drawdown, longest AS max_drawdown_duration,
    round(CASE WHEN down > 1e-12 THEN (mu - rf) / down ELSE 0 END * sqrt(52.0::DOUBLE), 4) AS sortino_ratio, round(CASE WHEN low < 0 THEN a / -low ELSE 0 END, 4) AS calmar_ratio, round(win * 100, 2) AS win_rate,
    round(coalesce(CASE WHEN loss > 0 THEN gain / loss ELSE 0 END, 0), 4) AS profit_loss_ratio, round((mu - rf - beta * (mb - rf)) * 52 * 100, 2) AS alpha, round(beta, 4) AS beta,
    round(CASE WHEN te > 1e-12 THEN (mu - mb) / te ELSE 0 END * sqrt(52.0::DOUBLE), 4) AS information_ratio FROM y"""

_RANK = "(rank() OVER (PARTITION BY factor, trade_date ORDER BY {0}) + (count(*) OVER (PARTITION BY factor, trade_date, {0}) - 1) / 2.0::DOUBLE) / count(*) OVER (PARTITION BY factor, trade_date)"

_MINING = f"""WITH p AS (SELECT ts_code, trade_date, close, volume, row_number() OVER w AS i, close / lag(close, 4) OVER w - 1 AS momentum, -(close / lag(close, 2) OVER w - 1) AS reversal,
    CASE WHEN count(*) OVER (w ROWS 7 PRECEDING) = 8 THEN volume / avg(volume) OVER (w ROWS 7 PRECEDING) END AS activity,
    CASE WHEN count(*) OVER (w ROWS 12 PRECEDING) = 13 THEN skewness(close) OVER (w ROWS 12 PRECEDING) END AS shape, abs(close - lag(close) OVER w) AS step, abs(close - lag(close, 8) OVER w) AS way, lead(close, 4) OVER w / close - 1 AS fwd
    FROM ({PANEL_SQL}) WINDOW w AS (PARTITION BY ts_code ORDER BY trade_date)),
  e AS (SELECT *, way / nullif(sum(step) OVER (PARTITION BY ts_code ORDER BY trade_date ROWS 7 PRECEDING), 0) AS trend FROM p),
  d AS (SELECT trade_date, row_number() OVER (ORDER BY trade_date) - 1 AS k, count(*) OVER () AS n FROM (SELECT DISTINCT trade_date FROM p)),
  f AS (SELECT fold, n, least(greatest(20, n // 4) + fold * greatest(3, n // 5), n - 3) AS train FROM (SELECT max(n) AS n FROM d), range(3) AS g(fold)),
  g AS (SELECT *, least(train + 5, n) AS a, least(least(train + 5, n) + greatest(3, n // 6), n - 2) AS b FROM f),
  h AS (SELECT *, least(b + 5, n) AS c, least(least(b + 5, n) + greatest(3, n // 7), n) AS z FROM g),
  parts AS (SELECT d.trade_date, CAST(h.fold AS INT) AS fold, x.part FROM d, h, (VALUES ('train'), ('valid'), ('test')) AS x(part)
    WHERE a < b AND c < z AND CASE x.part WHEN 'train' THEN k < train WHEN 'valid' THEN k >= a AND k < b ELSE k >= c AND k < z END),
  long AS (UNPIVOT (SELECT ts_code, trade_date, fwd, momentum, reversal, activity, shape, trend FROM e) ON momentum, reversal, activity, shape, trend INTO NAME factor VALUE v),
  ranked AS (SELECT factor, trade_date, fwd, {_RANK.replace('{0}', 'v')} AS rv, {_RANK.replace('{0}', 'fwd')} AS rf, row_number() OVER (PARTITION BY factor, trade_date ORDER BY v, ts_code) AS rn, count(*) OVER (PARTITION BY factor, trade_date) AS n FROM long WHERE fwd IS NOT NULL),
  daily AS (SELECT factor, trade_date, CASE WHEN stddev_pop(rv) * stddev_pop(rf) <> 0 THEN covar_pop(rv, rf) / (stddev_pop(rv) * stddev_pop(rf)) END AS ic,
    avg(fwd) FILTER (rn > n - greatest(1, n // 5)) - avg(fwd) FILTER (rn <= greatest(1, n // 5)) AS spread FROM ranked WHERE n >= 5 GROUP BY factor, trade_date),
  m AS (SELECT factor, fold, part, count(ic) AS dates, avg(ic) AS ic, nullif(stddev_samp(ic), 0) AS sd, avg(spread) AS spread, avg(CASE WHEN spread > 0 THEN 1.0::DOUBLE ELSE 0 END) AS win FROM daily JOIN parts ON parts.trade_date = daily.trade_date GROUP BY 1, 2, 3)"""

MINING_BATCH = f"{_MINING} SELECT factor, fold, part, dates, {_num('ic', 'ic_mean')}, {_num('ic / sd', 'ic_ir')}, {_num('ic / sd * sqrt(dates)', 't_stat')}, {_num('spread', 'spread')}, {_num('win', 'win_rate')} FROM m"

MINING_SCREEN = f"""{_MINING},
  cov AS (SELECT n.factor, parts.fold, 100.0::DOUBLE * sum(CASE n.factor WHEN 'momentum' THEN (momentum IS NOT NULL)::INT WHEN 'reversal' THEN (reversal IS NOT NULL)::INT WHEN 'activity' THEN (activity IS NOT NULL)::INT WHEN 'shape' THEN (shape IS NOT NULL)::INT ELSE (trend IS NOT NULL)::INT END) / count(*) AS coverage
    FROM e JOIN parts ON parts.trade_date = e.trade_date AND part = 'valid', (VALUES ('momentum'), ('reversal'), ('activity'), ('shape'), ('trend')) AS n(factor) GROUP BY 1, 2),
  j AS (SELECT cov.factor, cov.fold, coverage, dates, ic, ic / sd AS ir, 100 * spread AS spread FROM cov LEFT JOIN m ON m.factor = cov.factor AND m.fold = cov.fold AND m.part = 'valid')
  SELECT factor, fold, {_num('coverage', 'coverage')}, dates AS valid_dates, {_num('ic', 'valid_ic')}, {_num('ir', 'valid_ir')}, {_num('spread', 'spread')},
    CASE WHEN coalesce(dates, 0) < 3 THEN 'valid_ic_count_below_3' WHEN coalesce(coverage, 0) < 45 THEN 'coverage_below_45pct'
      WHEN abs(coalesce(ic, 0)) < 0.0015::DOUBLE AND abs(coalesce(spread, 0)) < 0.015::DOUBLE THEN 'validation_signal_near_zero'
      WHEN dates >= 10 AND abs(coalesce(ic, 0)) < 0.003::DOUBLE AND abs(coalesce(ir, 0)) < 0.08::DOUBLE THEN 'ic_and_icir_both_too_low' END AS fast_reject FROM j"""
