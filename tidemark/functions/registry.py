"""The functions of the factor language: names, axes and how SQL says them.

Each builder gets the SQL of its column arguments and its numeric parameters. Axis
``el`` works within a row, ``ts`` along a security's dates, ``xs`` across a date's
securities. Missing values are NULL and only NULL; a window that lacks a value has
none; division by zero is NULL. ``Dialect`` holds the few words in which Spark SQL and
the ANSI/DuckDB form of a query differ.
"""

from __future__ import annotations

import math
from collections import ChainMap
from collections.abc import Callable
from dataclasses import dataclass

KEY, TIME = "ts_code", "trade_date"


@dataclass(frozen=True)
class Dialect:
    name: str

    def filter_size(self, array: str, test: str) -> str:
        """How many v of an array pass."""
        return f"size(filter({array}, v -> {test}))" if self.name == "spark" else f"len(list_filter({array}, lambda v: {test}))"

    def collect(self, x: str, over: str) -> str:
        """Non-null values of a frame, in its order."""
        return f"collect_list({x}) OVER {over}" if self.name == "spark" else f"list({x}) FILTER ({x} IS NOT NULL) OVER {over}"

    def position(self, array: str, x: str) -> str:
        return f"array_position({array}, {x})" if self.name == "spark" else f"list_position({array}, {x})"

    def fold(self, array: str, step: str) -> str:
        """Left fold from the first element; a is the result so far, v the next."""
        if self.name == "spark":
            return f"aggregate(slice({array}, 2, greatest(size({array}) - 1, 0)), element_at({array}, 1), (a, v) -> {step})"
        return f"list_reduce({array}, lambda a, v: {step})"

    def dot(self, array: str, weights: list[float]) -> str:
        w = ", ".join(repr(float(x)) for x in weights)
        if self.name == "spark":
            return f"aggregate(zip_with({array}, array({w}), (p, q) -> p * q), CAST(0 AS DOUBLE), (a, v) -> a + v)"
        return f"list_sum(list_transform(list_zip({array}, [{w}]), lambda p: p[1] * p[2]))"

    def product(self, array: str) -> str:
        return self.fold(array, "a * v")


SPARK, DUCK = Dialect("spark"), Dialect("duck")


def frame(n: int, end: int = 0) -> str:
    return f"(PARTITION BY {KEY} ORDER BY {TIME} ROWS BETWEEN {n - 1 + end} PRECEDING AND {f'{end} PRECEDING' if end else 'CURRENT ROW'})"


ROWS = f"(PARTITION BY {KEY} ORDER BY {TIME})"
SO_FAR = f"(PARTITION BY {KEY} ORDER BY {TIME} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
DATE = f"(PARTITION BY {TIME})"


def div(a: str, b: str) -> str:
    return f"(({a}) / nullif({b}, CAST(0 AS DOUBLE)))"


def full(n: int, x: str, agg: str) -> str:
    """An aggregate of the last n rows, where none of them is missing."""
    return f"(CASE WHEN count({x}) OVER {frame(n)} = {n} THEN {agg} END)"


@dataclass(frozen=True)
class Function:
    name: str
    axis: str
    columns: int  # leading arguments that are columns
    params: tuple  # defaults of the numeric arguments after them; None: must be given
    build: Callable
    boolean: bool = False
    full_sample: bool = False  # looks at rows after its own


FUNCTIONS: dict[str, Function] = {}
#: Functions that only ``counted`` and ``LONG_WINDOWS`` write, and both kinds together.
STEPS: dict[str, Function] = {}
ALL = ChainMap(FUNCTIONS, STEPS)


def register(names: str, axis: str, columns: int, params: tuple = (), into: dict[str, Function] = FUNCTIONS, **kw):
    def put(build: Callable) -> Callable:
        for n in names.split():
            into[n] = Function(n, axis, columns, params, build, **kw)
        return build

    return put


N = int  # windows are whole rows


def _both(a: str, b: str) -> tuple[str, str]:
    """Two columns, each missing where the other is."""
    return f"(CASE WHEN {b} IS NOT NULL THEN {a} END)", f"(CASE WHEN {a} IS NOT NULL THEN {b} END)"


# --- within a row ---------------------------------------------------------
for _op in ("+", "-", "*"):
    register(_op, "el", 2)(lambda d, a, b, op=_op: f"({a} {op} {b})")
register("/", "el", 2)(lambda d, a, b: div(a, b))
for _op, _sql in (("<", "<"), (">", ">"), ("<=", "<="), (">=", ">="), ("==", "="), ("!=", "<>")):
    register(_op, "el", 2, boolean=True)(lambda d, a, b, op=_sql: f"({a} {op} {b})")
register("&", "el", 2, boolean=True)(lambda d, a, b: f"(coalesce({a}, false) AND coalesce({b}, false))")
register("|", "el", 2, boolean=True)(lambda d, a, b: f"(coalesce({a}, false) OR coalesce({b}, false))")
register("not", "el", 1, boolean=True)(lambda d, a: f"(NOT coalesce({a}, false))")
register("neg", "el", 1)(lambda d, a: f"(-{a})")
register("abs", "el", 1)(lambda d, a: f"abs({a})")
register("sign", "el", 1)(lambda d, a: f"CAST(CASE WHEN {a} > 0 THEN 1 WHEN {a} < 0 THEN -1 WHEN {a} = 0 THEN 0 END AS DOUBLE)")
register("log", "el", 1)(lambda d, a: f"round(ln(CASE WHEN {a} > 0 THEN {a} END), 12)")  # engines differ in the last places
register("sqrt", "el", 1)(lambda d, a: f"sqrt(CASE WHEN {a} >= 0 THEN {a} END)")
register("floor", "el", 1)(lambda d, a: f"CAST(floor({a}) AS DOUBLE)")
register("ceil", "el", 1)(lambda d, a: f"CAST(ceil({a}) AS DOUBLE)")
register("power **", "el", 2)(lambda d, a, b: f"(CASE WHEN ({a} > 0 OR {a} < 0 AND {b} = floor({b})) AND abs({b} * ln(abs(nullif({a}, CAST(0 AS DOUBLE))))) < 700 THEN power({a}, {b}) WHEN {a} = 0 AND {b} > 0 THEN CAST(0 AS DOUBLE) WHEN {a} = 0 AND {b} = 0 THEN CAST(1 AS DOUBLE) END)")
register("signedpower SignedPower", "el", 2)(lambda d, a, b: f"(CASE WHEN {a} = 0 AND {b} > 0 THEN {a} WHEN abs({b} * ln(abs(nullif({a}, CAST(0 AS DOUBLE))))) < 700 THEN (CASE WHEN {a} > 0 THEN 1 ELSE -1 END) * power(abs({a}), {b}) END)")
register("signed_log", "el", 1)(lambda d, a: f"(CASE WHEN {a} >= 0 THEN ln(1 + {a}) ELSE -ln(1 - {a}) END)")
register("max", "el", 2)(lambda d, a, b: f"(CASE WHEN {a} IS NOT NULL AND {b} IS NOT NULL THEN greatest({a}, {b}) END)")
register("min", "el", 2)(lambda d, a, b: f"(CASE WHEN {a} IS NOT NULL AND {b} IS NOT NULL THEN least({a}, {b}) END)")
register("fill", "el", 2)(lambda d, a, b: f"coalesce({a}, {b})")
register("where ternary", "el", 3)(lambda d, c, a, b: f"(CASE WHEN {c} THEN {a} ELSE {b} END)")
register("num_of", "el", 1)(lambda d, c: f"(CASE WHEN {c} THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END)")


@register("clip", "el", 1, (-3.0, 3.0))
def _clip(d, a, lo, hi):
    return f"(CASE WHEN {a} IS NOT NULL THEN least(greatest({a}, CAST({lo!r} AS DOUBLE)), CAST({hi!r} AS DOUBLE)) END)"


@register("round_val", "el", 1, (0,))
def _round_val(d, a, k):
    k = N(k)
    return f"CAST(bround({a}, {k}) AS DOUBLE)" if d.name == "spark" else f"(round_even({a} * {10.0 ** k!r}, 0) / {10.0 ** k!r})"


# --- along a security's dates ---------------------------------------------
register("delay", "ts", 1, (1,))(lambda d, x, n: f"lag({x}, {N(n)}) OVER {ROWS}" if n >= 0 else f"lead({x}, {N(-n)}) OVER {ROWS}")
register("delta", "ts", 1, (1,))(lambda d, x, n: f"({x} - lag({x}, {N(n)}) OVER {ROWS})")
register("pctchange", "ts", 1, (1,))(lambda d, x, n: f"({div(x, f'lag({x}, {N(n)}) OVER {ROWS}')} - 1)")
register("mean advm", "ts", 1, (20,))(lambda d, x, n: full(N(n), x, f"avg({x}) OVER {frame(N(n))}"))
register("sum", "ts", 1, (20,))(lambda d, x, n: full(N(n), x, f"sum({x}) OVER {frame(N(n))}"))
register("std", "ts", 1, (20,))(lambda d, x, n: full(N(n), x, f"stddev_samp({x}) OVER {frame(N(n))}"))
register("ts_max", "ts", 1, (20,))(lambda d, x, n: full(N(n), x, f"max({x}) OVER {frame(N(n))}"))
register("ts_min", "ts", 1, (20,))(lambda d, x, n: full(N(n), x, f"min({x}) OVER {frame(N(n))}"))
register("zscore", "ts", 1, (20,))(lambda d, x, n: full(N(n), x, div(f"{x} - avg({x}) OVER {frame(N(n))}", f"stddev_samp({x}) OVER {frame(N(n))}")))
register("breakout", "ts", 1, (20,), boolean=True)(lambda d, x, n: f"(CASE WHEN count({x}) OVER {frame(N(n), 1)} = {N(n)} THEN {x} > max({x}) OVER {frame(N(n), 1)} ELSE false END)")
register("drawdown_from_high", "ts", 1, (60,))(lambda d, x, n: full(N(n), x, f"({div(x, f'max({x}) OVER {frame(N(n))}')} - 1)"))
register("bars_since", "ts", 1)(lambda d, c: f"CAST(row_number() OVER {ROWS} - max(CASE WHEN {c} THEN bar_no END) OVER {SO_FAR} AS DOUBLE)")
register("count_true count", "ts", 1, (20,))(lambda d, c, n: f"(CASE WHEN count(1) OVER {frame(N(n))} = {N(n)} THEN CAST(sum(CASE WHEN {c} THEN 1 ELSE 0 END) OVER {frame(N(n))} AS DOUBLE) END)")
register("sumif", "ts", 2, (20,))(lambda d, x, c, n: full(N(n), x, f"sum(CASE WHEN {c} THEN {x} ELSE CAST(0 AS DOUBLE) END) OVER {frame(N(n))}"))
register("sumac cumsum", "ts", 1)(lambda d, x: f"sum({x}) OVER {SO_FAR}")
register("cross_up", "ts", 2, boolean=True)(lambda d, a, b: f"coalesce({a} > {b} AND lag({a}, 1) OVER {ROWS} <= lag({b}, 1) OVER {ROWS}, false)")
register("cross_down", "ts", 2, boolean=True)(lambda d, a, b: f"coalesce({a} < {b} AND lag({a}, 1) OVER {ROWS} >= lag({b}, 1) OVER {ROWS}, false)")


def _moment(fn: str):
    """A constant side has no correlation and a covariance of zero. Both are free of rounding errors (nine decimals; forty
    bits, and zero below 1e-12 of what they could be), so that ranks of equal ones tie."""

    def build(d, a, b, n):
        n = N(n)
        x, y = _both(a, b)
        w = frame(n)
        moving = " AND ".join(f"stddev_pop({v}) OVER {w} > 1e-9 * (1e-9 + abs(avg({v}) OVER {w}))" for v in (x, y))
        spread = f"stddev_pop({x}) OVER {w} * stddev_pop({y}) OVER {w}"
        if fn == "corr":
            value = div(f"covar_pop({x}, {y}) OVER {w}", f"(CASE WHEN {moving} THEN {spread} END)")
            value = f"round(least(greatest({value}, CAST(-1 AS DOUBLE)), CAST(1 AS DOUBLE)), 9)"
            value = f"(CASE WHEN {moving} THEN {value} END)"
        else:
            c = f"covar_samp({x}, {y}) OVER {w}"
            cut = f"CAST({float(2**13 + 1)!r} AS DOUBLE)"
            value = f"(CASE WHEN {moving} AND abs({c}) > 1e-12 * {spread} THEN {c} * {cut} - ({c} * {cut} - {c}) ELSE CAST(0 AS DOUBLE) END)"
        return f"(CASE WHEN count({x}) OVER {w} = {n} THEN {value} END)"

    return build


register("corr ts_corr_signed", "ts", 2, (20,))(_moment("corr"))
register("cov", "ts", 2, (20,))(_moment("cov"))


@register("regbeta", "ts", 2, (20,))
def _regbeta(d, a, b, n):
    """Slope of the second on the first, times n / (n - 1)."""
    n = N(n)
    x, y = _both(a, b)
    w = frame(n)
    return f"(CASE WHEN count({x}) OVER {w} = {n} THEN {div(f'covar_samp({x}, {y}) OVER {w}', f'var_pop({x}) OVER {w}')} END)"


@register("regresi", "ts", 2, (20,))
def _regresi(d, a, b, n):
    n, w = N(n), frame(N(n))
    beta = _regbeta(d, a, b, n)
    return f"({b} - (avg({b}) OVER {w} - {beta} * avg({a}) OVER {w}) - {beta} * {a})"


@register("skew", "ts", 1, (20,))
def _skew(d, x, n):
    n, w = N(n), frame(N(n))
    value = f"skewness({x}) OVER {w}"
    if d.name == "spark":
        value = f"({math.sqrt(n * (n - 1)) / (n - 2)!r} * {value})"
    return full(n, x, value)


@register("kurt", "ts", 1, (20,))
def _kurt(d, x, n):
    n, w = N(n), frame(N(n))
    value = f"kurtosis({x}) OVER {w}"
    if d.name == "spark":
        value = f"({(n - 1) / ((n - 2) * (n - 3))!r} * ({n + 1} * {value} + 6))"
    return full(n, x, value)


def _side(sign: str):
    def build(d, x, n):
        y = f"(CASE WHEN {x} {sign} 0 THEN {x} WHEN {x} IS NOT NULL THEN CAST(0 AS DOUBLE) END)"
        return full(N(n), x, f"stddev_samp({y}) OVER {frame(N(n))}")

    return build


register("downside_std", "ts", 1, (20,))(_side("<"))
register("upside_std", "ts", 1, (20,))(_side(">"))


@register("ts_rank", "ts", 1, (20,))
def _ts_rank(d, x, n):
    """Share of the window that is not above its last value."""
    n = N(n)
    return full(n, x, f"({d.filter_size(d.collect(x, frame(n)), f'v <= {x}')} / CAST({n} AS DOUBLE))")


@register("ts_pct_rank", "ts", 1, (20,))
def _ts_pct_rank(d, x, n):
    """Rank of the last value in its window as a share, ties averaged."""
    n = N(n)
    a = d.collect(x, frame(n))
    if d.name == "spark":  # one array, read once
        below = f"aggregate({a}, CAST(0 AS DOUBLE), (a, v) -> a + CASE WHEN v < {x} THEN 1.0D WHEN v = {x} THEN 0.5D ELSE 0.0D END)"
        return full(n, x, f"(({below} + 0.5D) / CAST({n} AS DOUBLE))")
    return full(n, x, f"(({d.filter_size(a, f'v < {x}')} + ({d.filter_size(a, f'v = {x}')} + 1) / CAST(2 AS DOUBLE)) / CAST({n} AS DOUBLE))")


def _arg(fn: str, back: bool):
    def build(d, x, n):
        n, w = N(n), frame(N(n))
        at = d.position(d.collect(x, w), f"{fn}({x}) OVER {w}")
        return full(n, x, f"CAST({n} - {at} AS DOUBLE)" if back else f"CAST({at} - 1 AS DOUBLE)")

    return build


register("ts_argmax Ts_ArgMax", "ts", 1, (20,))(_arg("max", False))
register("ts_argmin Ts_ArgMin", "ts", 1, (20,))(_arg("min", False))
register("highday", "ts", 1, (20,))(_arg("max", True))
register("lowday", "ts", 1, (20,))(_arg("min", True))
register("ts_product product", "ts", 1, (20,))(lambda d, x, n: full(N(n), x, d.product(d.collect(x, frame(N(n))))))


def _weighted(rising: bool):
    def build(d, x, n):
        n = N(n)
        w = [i / (n * (n + 1) / 2) for i in range(1, n + 1)]
        return full(n, x, d.dot(d.collect(x, frame(n)), w if rising else w[::-1]))

    return build


register("ts_decay wma", "ts", 1, (20,))(_weighted(True))
#: Its weights fall towards the newest row, as its users expect.
register("decaylinear", "ts", 1, (20,))(_weighted(False))


def _memory(alpha: float) -> int:
    """Rows after which an exponential weight is below 1e-12."""
    return max(2, math.ceil(-12 * math.log(10) / math.log(1 - alpha))) if alpha < 1 else 1


def _known(x: str) -> str:
    """The rows of a security that have a value, in order."""
    return f"(PARTITION BY {KEY}, ({x} IS NULL) ORDER BY {TIME})"


@register("decayed_pair", "ts", 1, (1, 0.5))
def _decayed_pair(d, x, k, w):
    """A value plus w times the one k known rows before: doubling k from 1 on sums any number of weights q**j in
    as many steps as that number has bits, without arrays."""
    return f"({x} + CAST({float(w)!r} AS DOUBLE) * coalesce(lag({x}, {N(k)}) OVER {_known(x)}, CAST(0 AS DOUBLE)))"


@register("decayed_ema", "ts", 2, (0.5,))
def _decayed_ema(d, total, x, alpha):
    """The recursion y = a x + (1 - a) y from its sum of weights; it starts at the first value."""
    q = f"CAST({1 - alpha!r} AS DOUBLE)"
    return f"({total} * CAST({alpha!r} AS DOUBLE) + {q} * power({q}, row_number() OVER {_known(x)} - 1) * first_value({x}) OVER {_known(x)})"


@register("decayed_mean", "ts", 2, (0.5,))
def _decayed_mean(d, total, x, alpha):
    """Exponentially weighted mean from its sum of weights, normalised."""
    return f"({total} * CAST({alpha!r} AS DOUBLE) / (1 - power(CAST({1 - alpha!r} AS DOUBLE), row_number() OVER {_known(x)})))"


def _decayed(end: str, alpha: float) -> str:
    out, k = "s", 1
    while k < _memory(alpha):
        out = f"decayed_pair({out}, {k}, {(1 - alpha) ** k!r})"
        k *= 2
    return f"{end}({out}, s, {alpha!r})"


@register("rank cs_rank cs_percentile", "ts", 1)
def _so_far_rank(d, x):
    """Rank among the rows up to now as a share, ties averaged: nothing is seen ahead. Spark counts it by ``COUNTED``."""
    a = d.collect(x, SO_FAR)
    return f"(CASE WHEN {x} IS NOT NULL THEN ({d.filter_size(a, f'v < {x}')} + ({d.filter_size(a, f'v = {x}')} + 1) / CAST(2 AS DOUBLE)) / CAST(count({x}) OVER {SO_FAR} AS DOUBLE) END)"


# Order statistics by counting along a tree over the ranks of values: a node's rows, by date, are a window, and how many of
# them went to each smaller child so far is a running count. A row visits one node a level, so n rows take n log n steps.
BITS, LEVELS = 4, 4  # children of a node: 16; levels unless the caller says how long histories are


@register("value_no", "ts", 1, (LEVELS,), into=STEPS)
def _value_no(d, x, levels):
    """Number of a value among the different ones of its security, from 0."""
    most = 1 << BITS * N(levels)
    no = f"dense_rank() OVER (PARTITION BY {KEY} ORDER BY {x} NULLS LAST) - 1"
    return f"(CASE WHEN {x} IS NOT NULL THEN CASE WHEN {no} >= {most} THEN CAST(raise_error('a security has over {most} different values: give a longer history') AS INT) ELSE {no} END END)"


def _child(no: str, level: int) -> tuple[str, str]:
    """A value's node at a level, and its child there."""
    return f"shiftright({no}, {BITS * (level + 1)})", f"(shiftright({no}, {BITS * level}) & {(1 << BITS) - 1})"


@register("fewer_at", "ts", 1, (0, 0), into=STEPS)
def _fewer_at(d, no, level, back):
    """Rows of the same node so far (until ``back`` rows ago) that went to a smaller child than this row."""
    node, child = _child(no, N(level))
    end = f"{N(back)} PRECEDING" if back else "CURRENT ROW"
    w = f"(PARTITION BY {KEY}, {node} ORDER BY bar_no RANGE BETWEEN UNBOUNDED PRECEDING AND {end})"
    return "(" + " + ".join(f"CASE WHEN {child} > {k} THEN count(CASE WHEN {child} = {k} THEN 1 END) OVER {w} ELSE 0 END" for k in range((1 << BITS) - 1)) + ")"


@register("equal_so_far", "ts", 1, (0,), into=STEPS)
def _equal_so_far(d, no, back):
    end = f"{N(back)} PRECEDING" if back else "CURRENT ROW"
    return f"(count({no}) OVER (PARTITION BY {KEY}, {no} ORDER BY bar_no RANGE BETWEEN UNBOUNDED PRECEDING AND {end}))"


register("known_so_far", "ts", 1, into=STEPS)(lambda d, x: f"(CASE WHEN {x} IS NOT NULL THEN count({x}) OVER {SO_FAR} END)")
register("known_in", "ts", 1, (20,), into=STEPS)(lambda d, x, n: full(N(n), x, f"CAST({N(n)} AS DOUBLE)"))


#: Rows beyond which ranks are counted along the tree and moments made by doubling, not in the window.
LONG = 60
#: One sum or extreme costs a sliding frame little: such windows are doubled from so many times that length on.
CHEAP, SIMPLE = 7, frozenset(("sum", "mean", "advm", "ts_max", "ts_min"))
#: A moment of two columns takes six aggregates of a frame: these windows are doubled beyond so many rows.
SHORT, PAIRS = 4, frozenset(("corr", "ts_corr_signed", "cov"))
#: Functions that ``counted`` writes.
RANKS = frozenset(("rank", "cs_rank", "cs_percentile", "ts_rank", "ts_pct_rank"))


def counted(levels: int) -> dict[str, tuple[tuple[str, ...], tuple, Callable[..., str]]]:
    """How Spark counts ranks with a tree of so many levels, in the form of ``MACROS``."""
    no = f"value_no(s, {levels})"

    def fewer(back: int = 0) -> str:
        return "(" + " + ".join(f"fewer_at({no}, {k}, {back})" for k in range(levels)) + ")"

    def window(n: int, equal: float, more: float) -> str:
        return f"({fewer()} - {fewer(n)} + {equal!r} * (equal_so_far({no}) - equal_so_far({no}, {n})) + {more!r}) / known_in(s, {n})"

    so_far = (("s",), (), lambda: f"({fewer()} + (equal_so_far({no}) + 1) / 2) / known_so_far(s)")
    return {
        "rank": so_far, "cs_rank": so_far, "cs_percentile": so_far,
        "ts_rank": (("s",), (20,), lambda n: window(N(n), 1.0, 0.0)),
        "ts_pct_rank": (("s",), (20,), lambda n: window(N(n), 0.5, 0.5)),
    }


def levels_for(history: int) -> int:
    """Levels that tell so many values apart."""
    return max(1, -(-max(1, history - 1).bit_length() // BITS))


# Moments of long windows by doubling: what two neighbouring blocks of k rows hold makes a block of 2k rows, so a window takes as
# many steps as its length has bits, each a lag. Means and squares of blocks are merged so that a constant block has none.
def _lag(x: str, k: float) -> str:
    return f"lag({x}, {N(k)}) OVER {ROWS}"


def _f(x: float) -> str:
    return f"CAST({float(x)!r} AS DOUBLE)"


register("pair_sum", "ts", 1, (1,), into=STEPS)(lambda d, x, k: f"({x} + {_lag(x, k)})")
register("pair_max", "ts", 1, (1,), into=STEPS)(lambda d, x, k: f"(CASE WHEN {_lag(x, k)} IS NOT NULL AND {x} IS NOT NULL THEN greatest({x}, {_lag(x, k)}) END)")
register("pair_min", "ts", 1, (1,), into=STEPS)(lambda d, x, k: f"(CASE WHEN {_lag(x, k)} IS NOT NULL AND {x} IS NOT NULL THEN least({x}, {_lag(x, k)}) END)")
register("pair_mean", "ts", 1, (1,), into=STEPS)(lambda d, m, k: f"(({m} + {_lag(m, k)}) / 2)")
register("pair_moment", "ts", 3, (1,), into=STEPS)(lambda d, q, m, w, k: f"({q} + {_lag(q, k)} + ({_lag(m, k)} - {m}) * ({_lag(w, k)} - {w}) * {_f(k / 2)})")
register("join_sum", "ts", 2, (1,), into=STEPS)(lambda d, x, y, a: f"({x} + {_lag(y, a)})")
register("join_mean", "ts", 2, (1, 1), into=STEPS)(lambda d, x, y, a, b: f"({x} + ({_lag(y, a)} - {x}) * {_f(b / (a + b))})")
register("join_moment", "ts", 6, (1, 1), into=STEPS)(lambda d, q, m, w, p, n, v, a, b: f"({q} + {_lag(p, a)} + ({_lag(n, a)} - {m}) * ({_lag(v, a)} - {w}) * {_f(a * b / (a + b))})")
register("beside", "el", 2, into=STEPS)(lambda d, x, y: f"(CASE WHEN {y} IS NOT NULL THEN {x} END)")
register("as_std", "el", 1, (20,), into=STEPS)(lambda d, q, n: f"sqrt({q} / {_f(n - 1)})")


def _as_moment(fn: str):
    def build(d, c, p, q, x, y, n):
        """The same as ``_moment`` makes of it."""
        sx, sy = f"sqrt({p} / {_f(n)})", f"sqrt({q} / {_f(n)})"
        moving = f"{sx} > 1e-9 * (1e-9 + abs({x})) AND {sy} > 1e-9 * (1e-9 + abs({y}))"
        if fn == "corr":
            return f"(CASE WHEN {moving} THEN round(least(greatest({div(f'{c} / {_f(n)}', f'{sx} * {sy}')}, CAST(-1 AS DOUBLE)), CAST(1 AS DOUBLE)), 9) END)"
        v, cut = f"({c} / {_f(n - 1)})", _f(2**13 + 1)
        return f"(CASE WHEN {c} IS NULL THEN NULL WHEN {moving} AND abs({v}) > 1e-12 * {sx} * {sy} THEN {v} * {cut} - ({v} * {cut} - {v}) ELSE CAST(0 AS DOUBLE) END)"

    return build


register("as_corr", "el", 5, (20,), into=STEPS)(_as_moment("corr"))
register("as_cov", "el", 5, (20,), into=STEPS)(_as_moment("cov"))


def _blocks(n: int) -> list[int]:
    """Sizes of the blocks that make up a window, from its last row back."""
    return [1 << k for k in range(n.bit_length()) if n >> k & 1]


def _doubled(op: str, x: str, size: int) -> str:
    out, k = x, 1
    while k < size:
        out, k = f"{op}({out}, {k})", 2 * k
    return out


def _long_sum(x: str, n: int) -> str:
    first, *rest = _blocks(n)
    out, held = _doubled("pair_sum", x, first), first
    for b in rest:
        out, held = f"join_sum({out}, {_doubled('pair_sum', x, b)}, {held})", held + b
    return out


def _long_best(op: str, x: str, n: int) -> str:
    """Greatest or least: two blocks that may overlap."""
    size = 1 << n.bit_length() - 1
    block = _doubled(f"pair_{op}", x, size)
    return block if size == n else f"{op}({block}, delay({block}, {n - size}))"


def _long_mean(x: str, n: int) -> str:
    first, *rest = _blocks(n)
    out, held = _doubled("pair_mean", x, first), first
    for b in rest:
        out, held = f"join_mean({out}, {_doubled('pair_mean', x, b)}, {held}, {b})", held + b
    return out


def _long_moment(x: str, y: str, n: int) -> str:
    """Sum of products of what x and y differ from their means."""

    def block(size: int) -> str:
        out, k = f"({x} * 0)", 1
        while k < size:
            out, k = f"pair_moment({out}, {_doubled('pair_mean', x, k)}, {_doubled('pair_mean', y, k)}, {k})", 2 * k
        return out

    first, *rest = _blocks(n)
    out, held = block(first), first
    for b in rest:
        means = f"{_long_mean(x, held)}, {_long_mean(y, held)}", f"{_doubled('pair_mean', x, b)}, {_doubled('pair_mean', y, b)}"
        out, held = f"join_moment({out}, {means[0]}, {block(b)}, {means[1]}, {held}, {b})", held + b
    return out


def _long_pair(end: str, n: int) -> str:
    x, y = "beside(s, t)", "beside(t, s)"
    return f"{end}({_long_moment(x, y, n)}, {_long_moment(x, x, n)}, {_long_moment(y, y, n)}, {_long_mean(x, n)}, {_long_mean(y, n)}, {n})"


_S, _ST = ("s",), ("s", "t")
#: How Spark computes windows of over ``LONG`` rows (``PAIRS``: ``SHORT``), in the form of ``MACROS``.
LONG_WINDOWS: dict[str, tuple[tuple[str, ...], tuple, Callable[..., str]]] = {
    "sum": (_S, (20,), lambda n: _long_sum("s", N(n))),
    "mean": (_S, (20,), lambda n: f"{_long_sum('s', N(n))} / {N(n)}"),
    "advm": (_S, (20,), lambda n: f"{_long_sum('s', N(n))} / {N(n)}"),
    "std": (_S, (20,), lambda n: f"as_std({_long_moment('s', 's', N(n))}, {N(n)})"),
    "ts_max": (_S, (20,), lambda n: _long_best("max", "s", N(n))),
    "ts_min": (_S, (20,), lambda n: _long_best("min", "s", N(n))),
    "corr": (_ST, (20,), lambda n: _long_pair("as_corr", N(n))),
    "ts_corr_signed": (_ST, (20,), lambda n: _long_pair("as_corr", N(n))),
    "cov": (_ST, (20,), lambda n: _long_pair("as_cov", N(n))),
}


register("cs_zscore", "ts", 1)(lambda d, x: f"coalesce(CASE WHEN count({x}) OVER {SO_FAR} >= 2 THEN {div(f'{x} - avg({x}) OVER {SO_FAR}', f'stddev_samp({x}) OVER {SO_FAR}')} END, CAST(0 AS DOUBLE))")
register("cs_demean indneutralize IndNeutralize", "ts", 1)(lambda d, x: f"({x} - avg({x}) OVER {SO_FAR})")
register("scale", "ts", 1)(lambda d, x: div(x, f"sum(abs({x})) OVER {SO_FAR}"))
register("prior_rank", "ts", 1)(lambda d, x: f"CAST(row_number() OVER {ROWS} AS DOUBLE)")


@register("winsorize", "ts", 1, (0.01, 0.99), full_sample=True)
def _winsorize(d, x, lo, hi):
    """Clips at quantiles of the whole series: it looks at later rows."""
    if d.name == "spark":
        a, b = (f"percentile({x}, {q!r}) OVER (PARTITION BY {KEY})" for q in (lo, hi))
    else:
        a, b = (f"quantile_cont({x}, {q!r}) OVER (PARTITION BY {KEY})" for q in (lo, hi))
    return f"(CASE WHEN {x} IS NOT NULL THEN least(greatest({x}, {a}), {b}) END)"


# --- across a date's securities -------------------------------------------
@register("xs_rank", "xs", 1)
def _xs_rank(d, x):
    """Rank within the date as a share, ties averaged; values that differ by less than
    1e-11 of their size are ties."""
    x = f"({x} * 131073.0D - ({x} * 131073.0D - {x}))" if d.name == "spark" else f"({x} * CAST(131073 AS DOUBLE) - ({x} * CAST(131073 AS DOUBLE) - {x}))"
    low = f"rank() OVER (PARTITION BY {TIME} ORDER BY {x} ASC NULLS LAST)"
    ties = f"count({x}) OVER (PARTITION BY {TIME}, {x})"
    return f"(CASE WHEN {x} IS NOT NULL THEN ({low} + ({ties} - 1) / CAST(2 AS DOUBLE)) / CAST(count({x}) OVER {DATE} AS DOUBLE) END)"


register("xs_demean", "xs", 1)(lambda d, x: f"({x} - avg({x}) OVER {DATE})")
register("xs_scale", "xs", 1)(lambda d, x: f"({x} / (sum(abs({x})) OVER {DATE} + CAST(1e-10 AS DOUBLE)))")
register("xs_zscore", "xs", 1)(lambda d, x: div(f"{x} - avg({x}) OVER {DATE}", f"stddev_pop({x}) OVER {DATE}"))


@register("xs_winsor", "xs", 1, (0.01, 0.99))
def _xs_winsor(d, x, lo, hi):
    f = "percentile({0}, {1!r})" if d.name == "spark" else "quantile_cont({0}, {1!r})"
    return f"(CASE WHEN {x} IS NOT NULL THEN least(greatest({x}, {f.format(x, lo)} OVER {DATE}), {f.format(x, hi)} OVER {DATE}) END)"


@register("xs_industry_demean", "xs", 1)
def _industry_demean(d, x):
    return f"({x} - avg({x}) OVER (PARTITION BY {TIME}, industry))"


@register("xs_slope_residual", "xs", 2)
def _slope_residual(d, y, x):
    """y less its slope on x in the date; both are demeaned already. A flat x explains nothing."""
    y2, x2 = _both(y, x)
    return f"({y} - {x} * coalesce(sum({x2} * {y2}) OVER {DATE} / nullif(round(sum({x2} * {x2}) OVER {DATE}, 12), CAST(0 AS DOUBLE)), CAST(0 AS DOUBLE)))"


#: Functions that are written with others.
MACROS: dict[str, tuple[tuple[str, ...], tuple, str | Callable[..., str]]] = {
    "ema": (("s",), (20,), lambda n: _decayed("decayed_ema", 2.0 / (n + 1))),
    "sma": (("s",), (20, 1), lambda n, m: _decayed("decayed_ema", float(m) / n)),
    "ewm": (("s",), (20,), lambda n: _decayed("decayed_mean", 2.0 / (n + 1))),
    "ic_ewm": (("s",), (20,), lambda n: _decayed("decayed_mean", 1 - 0.5 ** (2.0 / n))),
    # residual of y on x and industry dummies: demeaned within the industry, one slope a date
    "xs_industry_residual": (("y", "x"), (), "xs_slope_residual(xs_industry_demean(where(abs(x) >= 0, y, y / 0)), xs_industry_demean(where(abs(y) >= 0, x, x / 0)))"),
    "macd_dif": (("s",), (12, 26), "ema(s, {0}) - ema(s, {1})"),
    "macd_dea": (("s",), (12, 26, 9), "ema(ema(s, {0}) - ema(s, {1}), {2})"),
    "macd_hist": (("s",), (12, 26, 9), "(ema(s, {0}) - ema(s, {1})) - ema(ema(s, {0}) - ema(s, {1}), {2})"),
    "rsi": (("s",), (14,), "100 - 100 / (1 + mean(max(delta(s, 1), 0), {0}) / mean(max(neg(delta(s, 1)), 0), {0}))"),
    "efficiency_ratio": (("s",), (20,), "abs(s - delay(s, {0})) / sum(abs(delta(s, 1)), {0})"),
    "vol_zscore": ((), (20,), "zscore(volume, {0})"),
    "gap_pct": ((), (), "open / delay(close, 1) - 1"),
}

#: Variables that are written with others.
VARIABLES: dict[str, str] = {
    "vol": "volume",
    "returns": "pctchange(close, 1)",
    "vwap": "amount / volume",
    "dtm": "where(open <= delay(open, 1), 0, max(high - open, open - delay(open, 1)))",
    "dbm": "where(open >= delay(open, 1), 0, max(open - low, open - delay(open, 1)))",
    "tr": "max(max(high - low, abs(high - delay(close, 1))), abs(low - delay(close, 1)))",
    "hd": "high - delay(high, 1)",
    "ld": "delay(low, 1) - low",
}
#: Columns of a panel; those it lacks among the fundamentals are 0.
COLUMNS = ("open", "high", "low", "close", "volume", "amount")
FUNDAMENTALS = ("pe", "pb", "ps", "total_mv", "circ_mv", "turnover_rate")
