"""Candidates of the factor search as tables: cheap screens, likeness of curves, rankings,
replies of a text model, formula tags, registered factors.

Candidates are few (hundreds to thousands): pairs of them meet by date, orders over them are one task's.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import lexicon
from ..plans.compile import evaluate, significant
from ..sources.panel import PANEL_SQL, market_panel
from . import handmade, mining

# The first test that holds names the reason. Columns: valid_dates, coverage, valid_ic, valid_ir, spread; coverage and spread in percent.
SCREEN = {
    "valid_ic_count_below_3": "coalesce(valid_dates, 0) < 3",
    "coverage_below_45pct": "coalesce(coverage, 0) < 45",
    "validation_signal_near_zero": "abs(coalesce(valid_ic, 0)) < 0.0015D AND abs(coalesce(spread, 0)) < 0.015D",
    "ic_and_icir_both_too_low": "valid_dates >= 10 AND abs(coalesce(valid_ic, 0)) < 0.003D AND abs(coalesce(valid_ir, 0)) < 0.08D",
}
# Correlation of curves from which a candidate is too like an accepted one, and the lead in score that saves it.
ALIKE, SAME_FAMILY, SAME_THEME = 0.985, (0.96, 0.05), (0.94, 0.10)
QUOTA = 3


def screened(metrics: DataFrame) -> DataFrame:
    """metrics with ``fast_reject``: why a candidate isn't worth a backtest, or null."""
    tests = " ".join(f"WHEN {test} THEN '{name}'" for name, test in SCREEN.items())
    return metrics.withColumn("fast_reject", F.expr(f"CASE {tests} END"))


def curve_pairs(curves: DataFrame, candidates: DataFrame, least: float = SAME_THEME[0], days: int = 20) -> DataFrame:
    """(earlier, later, corr): candidates (name, place) whose curves (name, trade_date, value) correlate, either way,
    by ``least`` over their common dates, if those are ``days`` at least."""
    c = curves.join(candidates.select("name", "place"), "name")
    a = c.select("trade_date", F.col("name").alias("earlier"), F.col("place").alias("p"), F.col("value").alias("u"))
    b = c.select("trade_date", F.col("name").alias("later"), F.col("place").alias("q"), F.col("value").alias("v"))
    corr = F.abs(F.try_divide(F.covar_pop("u", "v"), F.stddev_pop("u") * F.stddev_pop("v")))
    met = a.join(b, "trade_date").where("p < q AND u IS NOT NULL AND v IS NOT NULL").groupBy("earlier", "later").agg(F.count(F.lit(1)).alias("n"), corr.alias("corr"))
    return met.where((F.col("n") >= days) & (F.col("corr") >= least)).select("earlier", "later", "corr")


def homogeneous(curves: DataFrame, candidates: DataFrame) -> DataFrame:
    """(name, reason): in order of ``place``, what rejects a candidate (name, place, structure, family, theme, score) against
    those accepted before: its structure's quota, or a curve too like one of theirs. Null accepts it.
    Correlations are one aggregation; the walk reads a row per candidate and per pair that is alike."""
    alike: dict[str, list[tuple[str, float]]] = {}
    for r in curve_pairs(curves, candidates).collect():
        alike.setdefault(r["later"], []).append((r["earlier"], r["corr"]))
    accepted, used, out = {}, {}, []
    for c in candidates.orderBy("place").collect():
        reason = "same_structure_quota_reached" if used.get(c["structure"], 0) >= QUOTA else None
        near = [] if reason else [(accepted[o], r) for o, r in alike.get(c["name"], ()) if o in accepted]
        for other, corr in sorted(near, key=lambda x: (-(x[0]["score"] or 0.0), x[0]["name"])):
            reason = reason or _too_like(c, other, corr)
        if reason is None:
            accepted[c["name"]] = c
            used[c["structure"]] = used.get(c["structure"], 0) + 1
        out.append((c["name"], reason))
    return curves.sparkSession.createDataFrame(out, "name string, reason string")


def _too_like(c, other, corr: float) -> str | None:
    lead = (c["score"] or 0.0) - (other["score"] or 0.0)
    same = lambda key, limits: corr >= limits[0] and bool(c[key]) and c[key] == other[key] and lead <= limits[1]
    if corr >= ALIKE:
        return "near_duplicate_equity_curve"
    return "same_family_high_curve_correlation" if same("family", SAME_FAMILY) else "same_theme_high_curve_correlation" if same("theme", SAME_THEME) else None


def elites(candidates: DataFrame, score: str, name: str, most: int = 200) -> DataFrame:
    """The best candidates by score; ties by name."""
    return candidates.orderBy(F.desc_nulls_last(score), name).limit(most)


def theme_scores(elite: DataFrame, most: int = 80) -> DataFrame:
    """(theme, weight): each of the best candidates (theme, score, excess, name) adds its score and a fiftieth of its
    excess (both floored, two hundredths at least) over the root of its place."""
    best = elites(elite, "score", "name", most)
    place = F.row_number().over(Window.orderBy(F.desc_nulls_last("score"), "name"))
    gain = F.greatest(F.coalesce("score", F.lit(0.0)), F.lit(-0.5)) + F.greatest(F.coalesce("excess", F.lit(0.0)), F.lit(-5.0)) / 50
    rows = best.select(F.coalesce("theme", F.lit("general_formula")).alias("theme"), (F.greatest(gain, F.lit(0.02)) / F.sqrt(place)).alias("w"))
    return rows.groupBy("theme").agg(F.sum("w").alias("weight"))


def reply_factors(text: Column) -> Column:
    """array<struct<name, expression, description>> of the JSON array that runs from the first ``[`` to the last ``]``
    of a reply; items without an expression and replies that aren't such an array give nothing."""
    a, b = F.instr(text, "["), F.length(text) - F.instr(F.reverse(text), "]") + 1
    items = F.from_json(F.when((a > 0) & (b > a) & F.contains(text, F.lit("]")), F.substring(text, a, b - a + 1)), "array<struct<name string, expression string, description string>>")
    return F.coalesce(F.filter(items, lambda x: x["expression"].isNotNull()), F.array())


def with_parameters(code: Column, values: dict[str, object]) -> Column:
    """Source text whose assignments of these names get these values; each name's first one."""
    for name, value in values.items():
        at = F.regexp_instr(code, F.lit(rf"\b{name}\s*="))
        head, tail = F.substring(code, F.lit(1), at - 1), F.substring(code, at, F.length(code))
        code = F.when(at > 0, F.concat(head, F.regexp_replace(tail, rf"^({name}\s*=\s*)[^\n#]+", rf"$1{value!r}"))).otherwise(code)
    return code


def tags(formula: Column) -> Column:
    """Tags of a formula by the functions and variables in it."""
    t = F.lower(formula)
    some = lambda ws: F.exists(F.array(*map(F.lit, ws)), lambda w: F.contains(t, w))
    found = F.array_compact(F.array(*[F.when(some(ws), F.lit(tag)) for tag, ws in lexicon.FORMULA_TAGS.items()]))
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit(lexicon.NO_TAG)))


#: Registered factors: name -> (category, description, maker of an expression).
FACTORS: dict[str, tuple[str, str, Callable[..., str]]] = {}


def factor(name: str, category: str = "custom", description: str = "") -> Callable[[Callable[..., str]], Callable[..., str]]:
    """Register a function that returns an expression of the factor language, perhaps from parameters."""

    def keep(make: Callable[..., str]) -> Callable[..., str]:
        FACTORS[name] = (category, description, make)
        return make

    return keep


def compute(panel: DataFrame, *names: str, **params: object) -> DataFrame:
    """ts_code, trade_date, and a column per registered factor; all of them in one plan."""
    return evaluate(panel, {n: FACTORS[n][2](**params) for n in names})


@factor("mid_gap", "price", "close against the middle of the day before")
def _mid_gap(lag: int = 1) -> str:
    return f"close / delay((high + low) / 2, {lag}) - 1"


# --- registered queries ----------------------------------------------------


def mining_screen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The batch's factors on each fold's valid part, and what rejects them before any backtest."""
    p = market_panel(spark, sf_dir)
    parts = mining.parts_by_date(p).where("part = 'valid'")
    keys = ["factor", "fold", "part"]
    m = mining.coverage(mining._stacked(p, mining.BATCH), parts).join(mining.batch_metrics(p, mining.BATCH), keys, "left")
    return mining.rounded(screened(m.select("factor", "fold", "coverage", F.col("dates").alias("valid_dates"), F.col("ic_mean").alias("valid_ic"), F.col("ic_ir").alias("valid_ir"), (F.col("spread") * 100).alias("spread"))))


def _industry_curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    return market_panel(spark, sf_dir).groupBy(F.col("industry").alias("name"), "trade_date").agg(F.avg("close").alias("value"))


def curve_likeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Industries as candidates: pairs of curves that correlate by 0.05 or more."""
    curves = _industry_curves(spark, sf_dir)
    names = curves.select("name").distinct().withColumn("place", F.substring("name", 2, 9).cast("int"))
    return curve_pairs(curves, names, 0.05).withColumn("corr", F.round("corr", 6))


def curve_homogeneity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Industries as candidates, of five structures: the quota leaves three of each."""
    curves = _industry_curves(spark, sf_dir)
    i = F.substring("name", 2, 9).cast("int")
    return homogeneous(curves, curves.select("name").distinct().select("name", i.alias("place"), (i % 5).cast("string").alias("structure"), F.lit("price").alias("family"), F.lit(None).cast("string").alias("theme"), F.lit(0.0).alias("score")))


def curve_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Industries by the leader of their cluster; the score is the number of the industry, negated."""
    curves = _industry_curves(spark, sf_dir)
    names = curves.select("name").distinct().select("name", F.substring("name", 2, 9).cast("int").alias("place"))
    return mining.leader_clusters(curves.withColumnRenamed("name", "factor"), names.select(F.col("name").alias("factor"), (-F.col("place")).cast("double").alias("score")), 0.05)


def elite_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    return elites(p.select("p_partkey", "p_retailprice"), "p_retailprice", "p_partkey")


def theme_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    t = theme_scores(p.select(F.col("p_type").alias("theme"), (F.col("p_retailprice") / 1000).alias("score"), (F.col("p_size") - 25.0).alias("excess"), F.col("p_partkey").alias("name")))
    return t.withColumn("weight", F.round("weight", 6))


def reply_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies made of parts: one item with an expression, one without; every fourth is cut off."""
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    reply = F.concat(F.lit('Sure: [{"name": "'), "p_name", F.lit('", "expression": "delay(close, '), F.col("p_size").cast("string"), F.lit(')"}, {"name": "none"}'), F.when(F.col("p_size") % 4 == 0, F.lit("")).otherwise(F.lit("] end")))
    return p.select("p_partkey", F.explode(reply_factors(reply)).alias("f")).select("p_partkey", "f.name", "f.expression")


def parameter_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    code = F.concat(F.lit("size = "), F.col("p_size").cast("string"), F.lit("  # as made\nsize = 1\nname = '"), "p_name", F.lit("'\n"))
    return p.select("p_partkey", with_parameters(code, {"size": 99, "name": "x", "absent": 1}).alias("code"))


def document_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.array_join(tags(F.coalesce("text", F.lit(""))), ",").alias("tags"))


def registered_factor(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = compute(market_panel(spark, sf_dir), "mid_gap")
    return c.select("ts_code", F.col("trade_date").cast("string").alias("trade_date"), F.expr(significant("round(mid_gap, 9) + CAST(0 AS DOUBLE)")).alias("mid_gap"))


_CURVES = f"c AS (SELECT CAST(substr(industry, 2) AS INT) AS i, industry AS name, trade_date, avg(close) AS value FROM ({PANEL_SQL}) AS p GROUP BY 1, 2, 3)"
_TAGS = ", ".join("CASE WHEN " + " OR ".join(f"contains(t, '{w}')" for w in ws) + f" THEN '{tag}' END" for tag, ws in lexicon.FORMULA_TAGS.items())

SQL: dict[str, str] = {
    "curve_likeness": f"""WITH {_CURVES} SELECT earlier, later, round(abs(r), 6) AS corr FROM (SELECT a.name AS earlier, b.name AS later, count(*) AS n, corr(a.value, b.value) AS r
      FROM c AS a JOIN c AS b ON a.trade_date = b.trade_date AND a.i < b.i GROUP BY 1, 2) AS x WHERE n >= 20 AND abs(r) >= 0.05""",
    "elite_parts": "SELECT p_partkey, p_retailprice FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 200",
    "theme_weights": """SELECT p_type AS theme, round(sum(greatest(greatest(p_retailprice / 1000, -0.5::DOUBLE) + greatest(p_size - 25.0::DOUBLE, -5) / 50, 0.02::DOUBLE) / sqrt(k)), 6) AS weight
      FROM (SELECT *, row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) AS k FROM part) AS x WHERE k <= 80 GROUP BY 1""",
    "reply_items": "SELECT p_partkey, p_name AS name, 'delay(close, ' || p_size || ')' AS expression FROM part WHERE p_size % 4 <> 0",
    "parameter_texts": "SELECT p_partkey, 'size = 99# as made' || chr(10) || 'size = 1' || chr(10) || 'name = ''x''' || chr(10) AS code FROM part",
    "document_tags": f"""WITH d AS (SELECT doc_id, lower(coalesce(text, '')) AS t FROM documents), g AS (SELECT doc_id, list_filter([{_TAGS}], lambda x: x IS NOT NULL) AS l FROM d)
      SELECT doc_id, CASE WHEN len(l) > 0 THEN array_to_string(l, ',') ELSE '{lexicon.NO_TAG}' END AS tags FROM g""",
    "registered_factor": f"""WITH p AS (SELECT *, lag((high + low) / 2) OVER (PARTITION BY ts_code ORDER BY trade_date) AS m FROM ({PANEL_SQL}) AS q)
      SELECT ts_code, CAST(trade_date AS VARCHAR) AS trade_date, {significant("round(close / m - 1, 9) + CAST(0 AS DOUBLE)")} AS mid_gap FROM p""",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (mining_screen, curve_likeness, curve_homogeneity, curve_clusters, elite_parts, theme_weights, reply_items, parameter_texts, document_tags, registered_factor)
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return SQL | {"mining_screen": handmade.MINING_SCREEN}
