"""Node graphs of visual workflows to expressions and back.

A graph is {"nodes": [{"id", "type", "params"}], "edges": [{"from": {"nodeId", "port"},
"to": {"nodeId", "port"}}]}. Both directions go through the expression tree, so that
every expression the language has survives the round trip.
"""

from __future__ import annotations

from .ast import ExpressionError, Node, parse

# Node type, expression function, input ports, parameters with defaults.
NODES: dict[str, tuple[str, tuple[str, ...], tuple[tuple[str, float], ...]]] = {
    "math_add": ("+", ("a", "b"), ()),
    "math_sub": ("-", ("a", "b"), ()),
    "math_mul": ("*", ("a", "b"), ()),
    "math_div": ("/", ("a", "b"), ()),
    "math_max": ("max", ("a", "b"), ()),
    "math_min": ("min", ("a", "b"), ()),
    "math_abs": ("abs", ("in",), ()),
    "math_log": ("log", ("in",), ()),
    "math_sqrt": ("sqrt", ("in",), ()),
    "math_neg": ("neg", ("in",), ()),
    "math_sign": ("sign", ("in",), ()),
    "math_floor": ("floor", ("in",), ()),
    "math_ceil": ("ceil", ("in",), ()),
    "math_power": ("power", ("in",), (("exp", 2.0),)),
    "math_signedpower": ("signedpower", ("in",), (("exp", 2.0),)),
    "math_clip": ("clip", ("in",), (("lower", -3.0), ("upper", 3.0))),
    "math_round": ("round_val", ("in",), (("decimals", 0.0),)),
    "ts_mean": ("mean", ("series",), (("window", 20.0),)),
    "ts_std": ("std", ("series",), (("window", 20.0),)),
    "ts_sum": ("sum", ("series",), (("window", 20.0),)),
    "ts_max": ("ts_max", ("series",), (("window", 20.0),)),
    "ts_min": ("ts_min", ("series",), (("window", 20.0),)),
    "ts_rank": ("ts_rank", ("series",), (("window", 20.0),)),
    "ts_decay": ("ts_decay", ("series",), (("window", 20.0),)),
    "ts_argmax": ("ts_argmax", ("series",), (("window", 20.0),)),
    "ts_argmin": ("ts_argmin", ("series",), (("window", 20.0),)),
    "ts_product": ("ts_product", ("series",), (("window", 20.0),)),
    "ts_highday": ("highday", ("series",), (("window", 20.0),)),
    "ts_lowday": ("lowday", ("series",), (("window", 20.0),)),
    "ts_wma": ("wma", ("series",), (("window", 20.0),)),
    "ts_decaylinear": ("decaylinear", ("series",), (("window", 20.0),)),
    "ts_delay": ("delay", ("series",), (("periods", 1.0),)),
    "ts_delta": ("delta", ("series",), (("periods", 1.0),)),
    "ts_pctchange": ("pctchange", ("series",), (("periods", 1.0),)),
    "ts_corr": ("corr", ("a", "b"), (("window", 20.0),)),
    "ts_cov": ("cov", ("a", "b"), (("window", 20.0),)),
    "ts_ewm": ("ewm", ("series",), (("span", 20.0),)),
    "ts_sma": ("sma", ("series",), (("window", 20.0), ("weight", 1.0))),
    "stat_regbeta": ("regbeta", ("x", "y"), (("window", 20.0),)),
    "stat_regresi": ("regresi", ("x", "y"), (("window", 20.0),)),
    "stat_sumif": ("sumif", ("series", "condition"), (("window", 20.0),)),
    "cs_rank": ("cs_rank", ("in",), ()),
    "cs_zscore": ("cs_zscore", ("in",), ()),
    "cs_percentile": ("cs_percentile", ("in",), ()),
    "cs_demean": ("cs_demean", ("in",), ()),
    "cs_scale": ("scale", ("in",), ()),
    "cs_indneutralize": ("indneutralize", ("in",), ()),
    "cs_advm": ("advm", ("in",), (("window", 20.0),)),
    "cond_gt": (">", ("a", "b"), ()),
    "cond_lt": ("<", ("a", "b"), ()),
    "cond_gte": (">=", ("a", "b"), ()),
    "cond_lte": ("<=", ("a", "b"), ()),
    "cond_eq": ("==", ("a", "b"), ()),
    "cond_and": ("&", ("a", "b"), ()),
    "cond_or": ("|", ("a", "b"), ()),
    "cond_not": ("not", ("in",), ()),
    "cond_ternary": ("where", ("cond", "true_val", "false_val"), ()),
}

# Input node types and their variables.
INPUTS = {
    "input_close": "close",
    "input_open": "open",
    "input_high": "high",
    "input_low": "low",
    "input_volume": "volume",
    "input_returns": "returns",
    "input_vwap": "vwap",
    "input_amount": "amount",
    "input_dtm": "dtm",
    "input_dbm": "dbm",
    "input_tr": "tr",
    "input_hd": "hd",
    "input_ld": "ld",
    "input_pe": "pe",
    "input_pb": "pb",
    "input_ps": "ps",
    "input_total_mv": "total_mv",
    "input_circ_mv": "circ_mv",
    "input_turnover": "turnover_rate",
}


def _inputs(graph: dict) -> tuple[dict, dict]:
    nodes = {n["id"]: n for n in graph.get("nodes", [])}
    wires: dict = {}
    for e in graph.get("edges", []):
        at = (e["to"]["nodeId"], e["to"]["port"])
        if e["from"]["nodeId"] not in nodes or at[0] not in nodes:
            raise ExpressionError(f"an edge refers to a missing node: {e}")
        if at in wires:
            raise ExpressionError(f"two wires end in {at}")
        wires[at] = e["from"]["nodeId"]
    return nodes, wires


def to_tree(graph: dict) -> Node:
    """The expression of a graph; ExpressionError for graphs without exactly one
    output, with unknown types, open or doubled inputs, or cycles."""
    nodes, wires = _inputs(graph)
    ends = [i for i, n in nodes.items() if n["type"] == "output"]
    if len(ends) != 1:
        raise ExpressionError("a graph has exactly one output")

    def build(i, path: tuple) -> Node:
        if i in path:
            raise ExpressionError("the graph has a cycle")
        n, path = nodes[i], (*path, i)
        kind, params = n["type"], n.get("params") or {}
        if kind in INPUTS:
            return Node("var", value=INPUTS[kind])
        if kind == "input_constant":
            return Node("num", value=float(params.get("value", 1.0)))
        if kind == "variable":
            return Node("var", value=params["name"])
        if kind == "output":
            op, ports, defaults = "", ("in",), ()
        elif kind == "function":
            op, ports, defaults = params["name"], tuple(f"arg{k}" for k in range(int(params["arity"]))), ()
        elif kind in NODES:
            op, ports, defaults = NODES[kind]
        else:
            raise ExpressionError(f"unknown node type {kind!r}")
        missing = [p for p in ports if (i, p) not in wires]
        if missing:
            raise ExpressionError(f"{kind} lacks {missing}")
        args = tuple(build(wires[i, p], path) for p in ports)
        if kind == "output":
            return args[0]
        return Node(op, args + tuple(Node("num", value=float(params.get(k, v))) for k, v in defaults))

    return build(ends[0], ())


def to_expression(graph: dict) -> str:
    return str(to_tree(graph))


def from_expression(expression: str | Node) -> dict:
    """A graph with the expression's meaning; functions without a node type become
    ``function`` nodes, so nothing is lost."""
    tree = parse(expression) if isinstance(expression, str) else expression
    graph: dict = {"nodes": [], "edges": []}
    kinds = {(op, len(ports) + len(ps)): (kind, ports, ps) for kind, (op, ports, ps) in NODES.items()}
    variables = {v: k for k, v in INPUTS.items()}

    def add(kind: str, params: dict) -> str:
        name = f"n{len(graph['nodes'])}"
        graph["nodes"].append({"id": name, "type": kind, "params": params})
        return name

    def wire(a: str, b: str, port: str) -> None:
        graph["edges"].append({"from": {"nodeId": a, "port": "out"}, "to": {"nodeId": b, "port": port}})

    def put(n: Node) -> str:
        if n.op == "num":
            return add("input_constant", {"value": n.value})
        if n.op == "var":
            return add(variables[n.value], {}) if n.value in variables else add("variable", {"name": n.value})
        hit = kinds.get((n.op, len(n.args)))
        if hit and all(a.op == "num" for a in n.args[len(hit[1]) :]):
            kind, ports, ps = hit
            me = add(kind, {k: a.value for (k, _), a in zip(ps, n.args[len(ports) :], strict=True)})
        else:
            ports = tuple(f"arg{k}" for k in range(len(n.args)))
            me = add("function", {"name": n.op, "arity": len(n.args)})
        for p, a in zip(ports, n.args, strict=False):
            wire(put(a), me, p)
        return me

    wire(put(tree), add("output", {}), "in")
    return graph
