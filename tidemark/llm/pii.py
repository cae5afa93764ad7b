"""Personal data by weak supervision.

Strict patterns give the base spans. Wider patterns propose further candidates
(numbers and addresses written another way, access secrets). On every candidate, base
ones too, regex, gazetteer and context labelers vote; expectation-maximisation over the
counts of vote patterns estimates each labeler's reliability without labels; a
logistic span classifier is then fitted to the posteriors and decides which
candidates join the base spans.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

#: The kinds of base spans, and the one that only the method finds.
BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "secret")
#: Labelers, in the order of their votes.
LABELERS = ("pattern", "checks", "gazetteer", "context", "surroundings")
#: Candidates with a posterior of at least this join the base spans.
ACCEPT = 0.5

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a match starts where a run of digits does: within one it would have started earlier, or fails likewise
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

# candidates: the same things written with other signs, and long runs of letters with digits
_AT = re.compile(r"[ ]?(?:@|\[at\]|\(at\)|\{at\}|<at>)[ ]?", re.I)
_DOT = re.compile(r"[ ]?(?:\.|\[dot\]|\(dot\)|\{dot\}|<dot>)[ ]?", re.I)
_WIDE_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:[ ]?(?:\.|\[dot\]|\(dot\)|\{dot\}|<dot>)[ ]?[A-Za-z0-9-]++)+", re.I)
_WIDE_IP = re.compile(r"(?<![0-9.])[0-9]{1,3}(?:[ ]?(?:\[\.\]|\(\.\)|\.)[ ]?[0-9]{1,3}){3}(?![0-9])")
_WIDE_CARD = re.compile(r"(?<![0-9])[0-9]{13,19}(?![0-9])|(?<![0-9])[0-9]{4}(?:[./_][0-9]{4}){3}(?![0-9])|(?<![0-9])[0-9]{4}[ -]{1,3}[0-9]{4}[ -]{1,3}[0-9]{4}[ -]{1,3}[0-9]{1,7}(?![0-9])")
_WIDE_PHONE = re.compile(r"(?<![0-9])(?:00[1-9][0-9]{0,2}[ .-]?)?(?:\([0-9]{2,4}\)[ ]?|[0-9]{2,4}[ .-])[0-9]{3,4}[ .-][0-9]{3,4}(?![0-9])")
_SECRET = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}={0,2}")
_HEX = re.compile(r"[0-9a-f]+|[0-9A-F]+")
_ASSIGNED = re.compile(r"([A-Za-z_-]+)[ ]?[=:][ ]?[\"'`]?$")

#: Endings of domain names, first digits of card issuers, calling codes.
TLDS = frozenset("com org net edu gov mil int info biz io co uk de fr es it nl be at ch us ca au jp cn in br mx pt pl se no dk fi ie eu".split())
ISSUERS = ("34", "37", "4", "51", "52", "53", "54", "55", "6011", "62", "65", "2221", "2720", "35", "36")
CALLING = ("+1", "+7", "+20", "+27", "+30", "+31", "+32", "+33", "+34", "+36", "+39", "+40", "+41", "+43", "+44", "+45", "+46", "+47", "+48", "+49", "+51", "+52", "+54", "+55", "+56", "+57", "+60", "+61", "+62", "+63", "+64", "+65", "+66", "+81", "+82", "+84", "+86", "+90", "+91")
#: Words near personal data, in four languages.
NEAR = {
    "email": frozenset("mail email e-mail contact kontakt correo courriel write schreiben adresse address".split()),
    "ip": frozenset("ip ipv4 host server client address adresse dirección login".split()),
    "card": frozenset("card visa mastercard amex credit kreditkarte karte carte tarjeta iban payment zahlung".split()),
    "phone": frozenset("phone tel telephone mobile cell call fax telefon teléfono téléphone handy móvil anrufen".split()),
    "secret": frozenset("token key apikey api_key api-key secret password passwd pwd credential credentials auth bearer authorization passwort kennwort contraseña clave".split()),
}
#: How issued keys begin, and the usual numbers of hexadecimal digits.
KEY_STARTS = ("AKIA", "ASIA", "ghp_", "gho_", "github_pat_", "glpat-", "sk-", "sk_live_", "pk_live_", "xoxb-", "xoxp-", "AIza", "ya29", "eyJ")
HEX_SIZES = (32, 40, 48, 56, 64, 96, 128)
_NAME = re.compile(r"[\w-]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        v = ord(d) - 48
        if i % 2:
            v = v * 2 - 9 if v > 4 else v * 2
        total += v
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _byte(digits: str) -> bool:
    """Whether the number is 255 at most, however many zeros lead it."""
    short = digits.lstrip("0")
    return len(short) <= 3 and int(short or "0") <= 255


def entropy(s: str) -> float:
    """Bits per sign."""
    return -sum(k / len(s) * math.log2(k / len(s)) for k in Counter(s).values())


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the strict patterns, by kind and start."""
    out = []
    at, free = text.find("@"), 0
    while at >= 0:
        a = at
        while a > free and text[a - 1] in _LOCAL:
            a -= 1
        m = _DOMAIN.match(text, at + 1) if a < at else None
        if m:
            out.append((0, a, m.end()))
            free = m.end()
        at = text.find("@", max(at + 1, free))
    for m in _IP.finditer(text):
        if all(_byte(p) for p in m[0].split(".")):
            out.append((1, m.start(), m.end()))
    for m in _CARD.finditer(text):
        d = _digits(m[0])
        if 13 <= len(d) <= 19 and luhn(d):
            out.append((2, m.start(), m.end()))
    for m in _PHONE.finditer(text):
        if 9 <= len(_digits(m[0])) <= 15:
            out.append((3, m.start(), m.end()))
    return out


def _wide_emails(text: str):
    """Addresses around each sign or word for "at": read from it to both sides."""
    free = 0
    for m in _AT.finditer(text):
        a = m.start()
        while a > free and text[a - 1] in _LOCAL:
            a -= 1
        while a < m.start() and text[a] in "._%+-":
            a += 1
        d = _WIDE_DOMAIN.match(text, m.end()) if a < m.start() else None
        if d:
            free = d.end()
            yield a, free


def wide_spans(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Further candidates that overlap no base span and no earlier candidate."""
    taken = bytearray(len(text))
    for _, a, b in base:
        taken[a:b] = b"\1" * (b - a)
    out = []

    def offer(kind: int, a: int, b: int) -> None:
        if taken.find(1, a, b) < 0:
            out.append((kind, a, b))
            taken[a:b] = b"\1" * (b - a)

    for a, b in _wide_emails(text):
        offer(0, a, b)
    for kind, p in ((4, _SECRET), (2, _WIDE_CARD), (1, _WIDE_IP), (3, _WIDE_PHONE)):
        for m in p.finditer(text):
            s = m[0]
            if kind < 4 or any(c.isdigit() for c in s) and any(c.isalpha() for c in s):
                offer(kind, m.start(), m.end())
    return out


def votes(text: str, kind: int, a: int, b: int, strict: bool) -> str:
    """One vote of +, - or 0 (abstains) from each labeler: the strict pattern; checks of the
    value; a gazetteer of names and prefixes; words before it; the signs around it."""
    s, d = text[a:b], _digits(text[a:b])
    before = text[max(0, a - 48) : a]
    out = ["+" if strict else "0"]
    if kind == 0:
        parts = [p for p in _DOT.split(_AT.split(s)[-1]) if p]
        out.append("+" if len(parts) > 1 and parts[-1].isalpha() and 2 <= len(parts[-1]) <= 24 else "-")
        out.append("+" if parts and parts[-1].lower() in TLDS else "-")
    elif kind == 1:
        parts = [p.lstrip("0") or "0" for p in re.findall(r"[0-9]+", s)]
        out.append("+" if len(parts) == 4 and all(_byte(p) for p in parts) else "-")
        out.append("-" if parts[0] in ("0", "255") else "+" if parts[0] in ("10", "127", "172", "192") else "0")
    elif kind == 2:
        out.append("+" if 13 <= len(d) <= 19 and luhn(d) else "-")
        out.append("+" if d.startswith(ISSUERS) else "-")
    elif kind == 3:
        out.append("+" if 9 <= len(d) <= 15 else "-")
        out.append("+" if s.startswith(CALLING) or s.startswith("00") or s.startswith("(") else "-" if re.fullmatch(r"(?:19|20)[0-9]{2}[ .-][0-9]{3,4}[ .-][0-9]{3,4}", s) else "0")
    else:
        out[0] = "+" if _HEX.fullmatch(s) and len(s) in HEX_SIZES or s.startswith(KEY_STARTS) else "0"
        # random signs: many bits each, letters and digits in turns; a name with a number has few changes
        turns = sum(x.isdigit() != y.isdigit() for x, y in zip(s[:128], s[1:128], strict=False))
        out.append("+" if entropy(s) >= 3.0 and turns * 6 >= min(len(s), 128) else "-")
        named = _ASSIGNED.search(before)
        out.append("+" if named and any(w in NEAR["secret"] for w in re.split(r"[_-]", named[1].lower())) else "0" if named else "-")
    near = set(_NAME.findall(before.lower()))
    own = NEAR[KINDS[kind]]
    other = any(near & NEAR[k] for k in KINDS if k != KINDS[kind])
    out.append("+" if near & own else "-" if other else "0")
    left, right = text[a - 1 : a], text[b : b + 1]
    if kind == 4:
        out.append("+" if left and left in "\"'`" and right == left else "-" if left.isalnum() or right.isalnum() else "0")
    else:
        out.append("-" if left.isalnum() or right.isalnum() or left in ("$", "#", "€") and left else "+")
    return "".join(out)


def shape(text: str, a: int, b: int) -> str:
    """Coarse form of a span: what stands between its parts, and how many digits."""
    s = text[a:b]
    signs = "".join(sorted({c for c in s if not c.isalnum()}))[:6]
    return f"{signs}|{min(len(_digits(s)), 20)}"


def reliabilities(patterns: dict[str, float], rounds: int = 100) -> tuple[float, np.ndarray, dict[str, float]]:
    """Expectation-maximisation for one kind over weighted vote patterns: the prior,
    the vote probabilities (labeler, class, vote -/0/+) and each pattern's posterior."""
    names = sorted(patterns)
    n = np.array([patterns[p] for p in names])
    v = np.array([["-0+".index(c) for c in p] for p in names])
    score = (v - 1).sum(axis=1)
    post = 1 / (1 + np.exp(-1.5 * score))  # starts from the majority
    theta, prior = np.zeros((v.shape[1], 2, 3)), 0.5
    for _ in range(rounds):
        w = np.stack([(1 - post) * n, post * n])
        prior = float((w[1].sum() + 1) / (n.sum() + 2))
        for j in range(v.shape[1]):
            for c in (0, 1):
                t = np.bincount(v[:, j], w[c], 3) + np.array([1.0, 1.0, 1.0]) + (np.array([0, 0, 1.0]) if c else np.array([1.0, 0, 0]))
                theta[j, c] = t / t.sum()
        logit = np.log(prior / (1 - prior)) + sum(np.log(theta[j, 1, v[:, j]] / theta[j, 0, v[:, j]]) for j in range(v.shape[1]))
        new = 1 / (1 + np.exp(-np.clip(logit, -40, 40)))
        done = np.abs(new - post).max() < 1e-7
        post = new
        if done:
            break
    return prior, theta, dict(zip(names, post.tolist(), strict=True))


def _row(pattern: str, form: str) -> np.ndarray:
    signs, digits = form.rsplit("|", 1)
    x = [1.0]
    for c in pattern:
        x += [float(c == "+"), float(c == "-")]
    x += [float(ch in signs) for ch in " -.()[]/+@"]
    x += [float(lo <= int(digits) < hi) for lo, hi in ((0, 9), (9, 13), (13, 17), (17, 99))]
    return np.array(x)


def classifier(counts: list[tuple[str, str, float]]) -> dict[tuple[str, str], float]:
    """For the (votes, shape, count) of one kind: the probability that each is
    personal data, from a logistic model fitted to the posteriors."""
    if not counts:
        return {}
    sums: dict[str, float] = {}
    for p, _, n in counts:
        sums[p] = sums.get(p, 0.0) + n
    post = reliabilities(sums)[2]
    x = np.array([_row(p, f) for p, f, _ in counts])
    y = np.array([post[p] for p, _, _ in counts])
    n = np.array([c for _, _, c in counts], float)
    n = n / n.sum() * min(n.sum(), 1e4)
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (n * (p - y)) + 0.1 * w
        h = (x * (n * p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(len(w))
        d = np.linalg.solve(h, g)
        w -= np.clip(d, -5, 5)
        if np.abs(d).max() < 1e-7:
            break
    p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
    return {(a, b): float(q) for (a, b, _), q in zip(counts, p, strict=True)}


SPAN = "array<struct<kind:int,start:int,end:int,base:boolean,votes:string,shape:string>>"


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, text_hash, found): all base spans and further candidates of each whole text."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    src = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("text_hash"))
    schema = C.struct(C.id_field(src), ("text_hash", "bigint"), ("found", SPAN))
    arrow = C.arrow_schema(schema)

    def run(batches):
        for b in batches:
            found = []
            for t in b.column(1).to_pylist():
                base = base_spans(t)
                spans = [(k, a, e, True) for k, a, e in base] + [(k, a, e, False) for k, a, e in wide_spans(t, base)]
                found.append([{"kind": k, "start": a, "end": e, "base": s, "votes": votes(t, k, a, e, s), "shape": shape(t, a, e)} for k, a, e, s in spans])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(found, arrow.field(2).type)], schema=arrow)

    return C.map_batches(src, run, schema)


def find_pii(docs: DataFrame, accept: float = ACCEPT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, text_hash, n_email, n_ip, n_card, n_phone (base spans),
    base_sha256, spans, n_added, found (kind, start, end, base, probability).

    Base spans are of the first four kinds and always stay; what the method adds may be of
    any kind, access secrets included. Offsets are code points, ends exclusive. Null text is empty and has no span; ids
    are only passed on, so null or repeated ones make no difference. An empty table
    gives an empty result; other columns are ignored.
    """
    rows = C.staged(candidates(docs, id_col, text_col), "candidates")
    each = rows.select(F.explode("found").alias("f")).select("f.kind", "f.votes", "f.shape")
    # a few votes by a few shapes: the number of patterns does not follow the input
    table = each.groupBy("kind", "votes", "shape").agg(F.count(F.lit(1)).alias("n")).collect()
    known: dict[int, dict[tuple[str, str], float]] = {}
    for k in range(len(KINDS)):
        known[k] = classifier([(r["votes"], r["shape"], float(r["n"])) for r in table if r["kind"] == k])
    sent = docs.sparkSession.sparkContext.broadcast(known)
    ident = C.id_field(rows)
    counts = [(f"n_{k}", "bigint") for k in BASE_KINDS]
    schema = C.struct(ident, ("text_hash", "bigint"), *counts, ("base", "string"), ("spans", "string"), ("n_added", "bigint"), ("found", "array<struct<kind:string,start:int,end:int,base:boolean,probability:double>>"))
    arrow = C.arrow_schema(schema)

    def decide(batches):
        model = sent.value
        for b in batches:
            cols: list[list] = [[] for _ in range(8)]
            for found in b.column(2).to_pylist():
                kept = []
                for f in found:
                    p = model[f["kind"]].get((f["votes"], f["shape"]), 0.0)
                    if f["base"] or p >= accept:
                        kept.append((f["kind"], f["start"], f["end"], f["base"], p))
                kept.sort()
                name = lambda x: f"{KINDS[x[0]]}:{x[1]}:{x[2]}"
                for k in range(4):
                    cols[k].append(sum(x[0] == k and x[3] for x in kept))
                cols[4].append(",".join(name(x) for x in kept if x[3]))
                cols[5].append(",".join(map(name, kept)))
                cols[6].append(sum(not x[3] for x in kept))
                cols[7].append([{"kind": KINDS[x[0]], "start": x[1], "end": x[2], "base": x[3], "probability": x[4]} for x in kept])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *[pa.array(c, arrow.field(i + 2).type) for i, c in enumerate(cols)]], schema=arrow)

    out = C.map_batches(rows, decide, schema)
    return out.select("doc_id", "text_hash", *[f"n_{k}" for k in BASE_KINDS], F.sha2(F.col("base").cast("binary"), 256).alias("base_sha256"), "spans", "n_added", "found")


def redact(docs: DataFrame, accept: float = ACCEPT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with each span replaced by its kind in brackets; null text stays null. Rows meet
    their spans by id and text, so repeated or null ids and columns of any name do no harm."""
    spans = find_pii(docs, accept, id_col, text_col).where(F.size("found") > 0).select("doc_id", "text_hash", "found").dropDuplicates(["doc_id", "text_hash"])

    @F.pandas_udf("string")
    def replace(texts, found):
        import pandas as pd

        out = []
        for t, own in zip(texts, found, strict=True):
            if t is not None and own is not None:
                last, parts = len(t), []
                for s in sorted(own, key=lambda s: -s["start"]):
                    if s["end"] <= last:
                        parts += [t[s["end"] : last], f"[{s['kind'].upper()}]"]
                        last = s["start"]
                t = "".join([t[:last], *reversed(parts)])
            out.append(t)
        return pd.Series(out)

    C.tune(docs.sparkSession)
    rows = docs.select(F.struct("*").alias("row"))
    text = F.col("row").getField(text_col)
    rows = rows.withColumn("th", F.xxhash64(F.coalesce(text, F.lit(""))))
    met = rows.join(spans.hint("shuffle_hash"), F.col("row").getField(id_col).eqNullSafe(spans["doc_id"]) & (rows["th"] == spans["text_hash"]), "left")
    return met.select(*[replace(text, F.col("found")).alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in docs.columns])
