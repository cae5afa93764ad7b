"""From expressions to layered SQL over a panel.

Equal subtrees of all expressions of a batch are one column (hash-consing). Layers
are scheduled by axis: everything that can be computed along securities comes before
the switch to dates, and back, so a batch has as many shuffles as its deepest
expression has switches, not as many as it has expressions.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from ..functions import registry as R
from .ast import ExpressionError, Node, parse, walk


def _macro(node: Node, levels: int):
    """How the node is written with other functions, if it is; with ``levels``, ranks and long windows as well."""
    if levels and (node.op in R.RANKS or node.op in R.LONG_WINDOWS):
        names, defaults, _ = macro = R.LONG_WINDOWS.get(node.op) or R.counted(levels)[node.op]
        window = [*map(_number, node.args[len(names) :]), *defaults]
        least = min(R.LONG, R.SHORT) if node.op in R.PAIRS else R.LONG * (R.CHEAP if node.op in R.SIMPLE else 1)
        return macro if not window or window[0] > least else None
    return R.MACROS.get(node.op)


def expand(node: Node, columns: frozenset[str], levels: int = 0) -> Node:
    """Macros and derived variables written out; names checked."""
    if node.op == "num":
        return node
    if node.op == "var":
        name = str(node.value)
        if name in columns:
            return node
        if name in R.VARIABLES:
            return expand(parse(R.VARIABLES[name]), columns, levels)
        if name in R.FUNDAMENTALS:
            return Node("num", value=0.0)
        raise ExpressionError(f"unknown variable {name!r}")
    if macro := _macro(node, levels):
        names, defaults, text = macro
        given = node.args[len(names) :]
        params = [*map(_number, given), *defaults[len(given) :]]
        if len(node.args) < len(names) or len(given) > len(defaults):
            raise ExpressionError(f"{node.op} takes {len(names)} columns and {len(defaults)} numbers")
        body = parse(text(*params) if callable(text) else text.format(*params))
        return expand(_put(body, dict(zip(names, node.args, strict=False))), columns, levels)
    if node.op not in R.ALL:
        raise ExpressionError(f"unknown function {node.op!r}")
    f = R.ALL[node.op]
    if not f.columns <= len(node.args) <= f.columns + len(f.params):
        raise ExpressionError(f"{node.op} takes {f.columns} columns and up to {len(f.params)} numbers")
    cols = tuple(expand(a, columns, levels) for a in node.args[: f.columns])
    nums = tuple(Node("num", value=v) for v in [*map(_number, node.args[f.columns :]), *f.params[len(node.args) - f.columns :]])
    return Node(node.op, cols + nums)


def _put(node: Node, names: dict[str, Node]) -> Node:
    if node.op == "var" and node.value in names:
        return names[str(node.value)]
    return Node(node.op, tuple(_put(a, names) for a in node.args), node.value)


def _number(node: Node) -> float:
    if node.op == "num":
        return float(node.value)
    if node.op == "neg":
        return -_number(node.args[0])
    if node.op in "+-*/" and len(node.args) == 2:
        a, b = map(_number, node.args)
        return {"+": a + b, "-": a - b, "*": a * b, "/": a / b if b else 0.0}[node.op]
    raise ExpressionError(f"a number is needed, not {node}")


@dataclass
class Layer:
    axis: str
    columns: list[tuple[str, Node]]


@dataclass
class Plan:
    layers: list[Layer]
    outputs: dict[str, str]
    names: dict[Node, str]

    def switches(self) -> int:
        """How often the partitioning changes."""
        axes = [x.axis for x in self.layers if x.axis != "el"]
        return sum(a != b for a, b in zip(["", *axes], axes, strict=False))


def schedule(expressions: dict[str, str | Node], columns: frozenset[str], levels: int = 0) -> Plan:
    trees = {k: expand(parse(e) if isinstance(e, str) else e, columns, levels) for k, e in expressions.items()}
    nodes: dict[Node, str] = {}
    for t in trees.values():
        for n in walk(t):
            if n.op not in ("num", "var") and n not in nodes:
                nodes[n] = f"_c{len(nodes)}"
    todo, done, layers, axis = dict(nodes), set(), [], "ts"

    def ready(n: Node) -> bool:
        return all(a.op in ("num", "var") or a in done for a in n.args[: R.ALL[n.op].columns])

    while todo:
        # whatever needs no shuffle first, then the axis at hand as far as it goes
        for kind in ("el", axis, "xs" if axis == "ts" else "ts"):
            now = [(name, n) for n, name in todo.items() if R.ALL[n.op].axis == kind and ready(n)]
            if now:
                break
        else:
            raise ExpressionError("the expressions refer to each other")
        if kind != "el":
            axis = kind
        layers.append(Layer(kind, now))
        for _, n in now:
            done.add(n)
            del todo[n]
    return Plan(layers, {k: t for k, t in trees.items()}, nodes)


def _sql(node: Node, names: dict[Node, str], d: R.Dialect) -> str:
    f = R.ALL[node.op]
    cols = [_ref(a, names) for a in node.args[: f.columns]]
    # a condition used as a number, a number used as a condition
    for i, a in enumerate(node.args[: f.columns]):
        truth = a.op in R.ALL and R.ALL[a.op].boolean
        wants = node.op in ("&", "|", "not", "num_of", "bars_since", "count_true", "count") or node.op in ("where", "ternary") and i == 0 or node.op == "sumif" and i == 1
        if truth and not wants:
            cols[i] = f"CAST(CASE WHEN {cols[i]} THEN 1 WHEN NOT {cols[i]} THEN 0 END AS DOUBLE)"
        elif wants and not truth and a.op != "num":
            cols[i] = f"({cols[i]} <> 0)"
    return f.build(d, *cols, *[a.value for a in node.args[f.columns :]])


def _ref(node: Node, names: dict[Node, str]) -> str:
    if node.op == "num":
        return f"CAST({float(node.value)!r} AS DOUBLE)"
    return str(node.value) if node.op == "var" else names[node]


def significant(x: str, bits: int = 20) -> str:
    """x with so many significant bits, by Veltkamp splitting: what differs in the last
    places between engines is not kept."""
    c = f"CAST({float(2 ** (53 - bits) + 1)!r} AS DOUBLE)"
    return f"(({x}) * {c} - (({x}) * {c} - ({x})))"


def _final(plan: Plan, keep: tuple[str, ...], d: R.Dialect, bits: int | None) -> list[str]:
    out = list(keep)
    for name, tree in plan.outputs.items():
        x = _ref(tree, plan.names)
        if tree.op in R.ALL and R.ALL[tree.op].boolean:
            x = f"CAST(CASE WHEN {x} THEN 1 WHEN NOT {x} THEN 0 END AS DOUBLE)"
        out.append(f"{significant(f'(CASE WHEN abs({x}) < 1e-9 THEN CAST(0 AS DOUBLE) ELSE {x} END)', bits) if bits else x} AS {name}")
    return out


BASE = ("bar_no",)
#: Dates are few, so hashes deal them unevenly: into so many times the tasks of securities, up to a number beyond which most would be empty.
UNEVEN, MOST_OF_DATES = 4, 1500


def evaluate(panel: DataFrame, expressions: dict[str, str | Node], keep: tuple[str, ...] = (R.KEY, R.TIME), bits: int | None = None, history: int = 1 << 16, parts: int | None = None) -> DataFrame:
    """panel with one column per expression. ``history`` is the most rows of a security (ranks of longer ones fail, and
    are counted the faster the shorter it is). ``bits`` rounds results to so many
    significant bits (less than 1e-9 is 0), which makes them equal across engines. ``parts``: into how many tasks rows are dealt where
    the axis changes, if the session's number is smaller; windows keep a task's rows in memory, so it should follow the input."""
    plan = schedule(expressions, frozenset(panel.columns), R.levels_for(history))
    df = panel.selectExpr("*", f"row_number() OVER {R.ROWS} AS bar_no") if _needs_bar_no(plan) else panel
    deal = parts and parts > int(panel.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    axis = "ts"
    for layer in plan.layers:
        if deal and layer.axis not in ("el", axis):
            axis = layer.axis
            df = df.repartition(parts, R.KEY) if axis == "ts" else df.repartition(min(UNEVEN * parts, MOST_OF_DATES), R.TIME)
        df = df.selectExpr("*", *[f"{_sql(n, plan.names, R.SPARK)} AS {name}" for name, n in layer.columns])
    return df.selectExpr(*_final(plan, keep, R.SPARK, bits))


def _needs_bar_no(plan: Plan) -> bool:
    return any(n.op in ("bars_since", "fewer_at", "equal_so_far") for n in plan.names)


def to_sql(source: str, columns: frozenset[str], expressions: dict[str, str | Node], keep: tuple[str, ...] = (R.KEY, R.TIME), bits: int | None = None) -> str:
    """The same plan as one ANSI statement over the relation ``source``."""
    plan = schedule(expressions, columns)
    steps = [f"l0 AS (SELECT *{f', row_number() OVER {R.ROWS} AS bar_no' if _needs_bar_no(plan) else ''} FROM {source})"]
    for i, layer in enumerate(plan.layers, 1):
        steps.append(f"l{i} AS (SELECT *, {', '.join(f'{_sql(n, plan.names, R.DUCK)} AS {name}' for name, n in layer.columns)} FROM l{i - 1})")
    return f"WITH {', '.join(steps)} SELECT {', '.join(_final(plan, keep, R.DUCK, bits))} FROM l{len(plan.layers)}"


def looks_ahead(expression: str | Node) -> bool:
    """Whether a value may depend on later rows: whole-sample functions or negative delays."""
    tree = parse(expression) if isinstance(expression, str) else expression
    for n in walk(tree):
        f = R.ALL.get(n.op)
        if f and f.full_sample:
            return True
        if n.op in ("delay", "delta", "pctchange") and len(n.args) > 1 and _number(n.args[1]) < 0:
            return True
    return False
