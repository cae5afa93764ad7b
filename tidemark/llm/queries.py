"""The registered queries of the training-data operators and their DuckDB oracles.

Each query applies its operator, with production parameters, to whole tables and
keeps the columns that its contract names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, divergence, exact_dedup, html_text, lattice_lm, line_dedup, mixing, ngram_join, packing, periodic_runs, pii, suffix_dedup, toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_pii(_table(spark, sf_dir, "documents")).drop("found", "text_hash")


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    out = line_dedup.dedup_lines(docs)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op3_lattice_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice_lm.score(_table(spark, sf_dir, "documents"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")).drop("items", "spans", "key")


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(_table(spark, sf_dir, "documents"))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeated_bytes(_table(spark, sf_dir, "documents"))


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similar_components(_table(spark, sf_dir, "documents"), size=3, num=90, den=100)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(_table(spark, sf_dir, "pages"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.digests(periodic_runs.find_runs(periodic_runs.plant(_table(spark, sf_dir, "documents"))))


def op12_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, _ = mixing.mix(_table(spark, sf_dir, "documents"))
    return documents.select("doc_id", "size", "source_size", "target", "taken")


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    import corpus_pipeline

    own = (op1_pii, op2_line_dedup, op3_lattice_lm, op4_packing, op5_decontamination, op6_exact_dedup, op7_suffix_dedup, op8_ngram_join, op9_toxicity, op10_html_text, op11_periodic_runs, op12_mixing, op13_divergence)
    return {f.__name__: f for f in own} | {"pipeline": corpus_pipeline.run}


_LOW = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP2_SQL = r"""
WITH rows_ AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
lines AS (
  SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS pos FROM rows_),
keyed AS (
  SELECT doc_id, pos, line,
         translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines),
often AS (
  SELECT key, max(doc_id) AS last FROM keyed WHERE length(key) >= 20
  GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
judged AS (
  SELECT k.doc_id, k.pos, k.line, o.key IS NOT NULL AND k.doc_id <> o.last AS gone
  FROM keyed k LEFT JOIN often o ON k.key = o.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""

OP5_SQL = r"""
WITH dw AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
bw AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
win AS (
  SELECT DISTINCT item_id, least(10, len(ws)) AS k, array_to_string(ws[i : i + least(10, len(ws)) - 1], ' ') AS w
  FROM (SELECT item_id, ws, unnest(range(1, len(ws) - least(10, len(ws)) + 2)) AS i FROM bw WHERE len(ws) > 0)),
ks AS (SELECT DISTINCT k FROM win),
occ AS (
  SELECT doc_id, k, i, array_to_string(ws[i : i + k - 1], ' ') AS w
  FROM (SELECT doc_id, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM dw, ks WHERE len(ws) >= k)),
hits AS (SELECT o.doc_id, o.i, o.k, n.item_id FROM occ o JOIN win n ON o.k = n.k AND o.w = n.w),
pos AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + k)) AS p FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS all_items
          FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.ws) AS BIGINT) AS n_words, coalesce(p.n_hit, 0) AS n_hit, coalesce(i.n_items, 0) AS n_items,
       sha256(coalesce(i.all_items, '')) AS items_sha256, coalesce(p.n_hit, 0) > 0 AS contaminated
FROM dw d LEFT JOIN pos p ON p.doc_id = d.doc_id LEFT JOIN items i ON i.doc_id = d.doc_id
"""

OP6_SQL = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM n
"""

OP8_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
g AS (
  SELECT DISTINCT doc_id, array_to_string(ws[i : i + 2], ' ') AS s
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 2, 1) + 1)) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS k FROM g GROUP BY doc_id),
both_ AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS common
  FROM g a JOIN g b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (
  SELECT x, y FROM both_ JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y
  WHERE 100 * common >= 90 * (p.k + q.k - common)),
edges AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach(x, y) AS (
  SELECT doc_id, doc_id FROM w
  UNION
  SELECT r.x, e.y FROM reach r JOIN edges e ON e.x = r.y)
SELECT w.doc_id, coalesce(n.k, 0) AS n_shingles, (SELECT min(r.y) FROM reach r WHERE r.x = w.doc_id) AS component_id
FROM w LEFT JOIN n ON n.doc_id = w.doc_id
"""


OP11_SQL = r"""
WITH ids AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws,
         xor(list_reduce(
           list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: [ascii(c)::BIGINT, 0, 0, 0, 0, 0, 0, 0]))),
           lambda a, x: xor(xor(a, x) >> 1, (xor(a, x) & 1) * 3988292384::BIGINT)), 4294967295::BIGINT) AS h
  FROM documents),
cut AS (
  SELECT doc_id, ws, len(ws) AS n, h % 10 = 0 AND len(ws) > 0 AS planted, (h // 10) % greatest(len(ws), 1) AS a,
         1 + (len(ws) - (h // 10) % greatest(len(ws), 1)) // (3 + (h // 10) % 8) AS p
  FROM ids),
w AS (
  SELECT doc_id, i, ws[1 + CASE WHEN planted AND i >= a THEN a + (i - a) % p ELSE i END] AS word
  FROM (SELECT *, unnest(range(n)) AS i FROM cut)),
pairs AS (
  SELECT x.doc_id, x.i, y.i - x.i AS q FROM w x JOIN w y ON x.doc_id = y.doc_id AND x.word = y.word AND y.i > x.i),
islands AS (
  SELECT doc_id, q, min(i) AS s, count(*) AS k
  FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM pairs) GROUP BY doc_id, q, island),
runs AS (
  SELECT doc_id, s, k + q AS l, min(q) AS q FROM islands WHERE k >= greatest(12 - q, q) GROUP BY doc_id, s, k + q),
lost AS (SELECT DISTINCT doc_id, unnest(range(s + q, s + l)) AS i FROM runs),
kept AS (
  SELECT w.doc_id, string_agg(word, ' ' ORDER BY w.i) AS kept FROM w ANTI JOIN lost ON w.doc_id = lost.doc_id AND w.i = lost.i GROUP BY w.doc_id),
best AS (
  SELECT doc_id, count(*) AS n_runs, string_agg(s || ',' || l || ',' || q || chr(10), '' ORDER BY s, q) AS listed,
         first(struct_pack(s := s, l := l, q := q) ORDER BY l DESC, s, q) AS top
  FROM runs GROUP BY doc_id)
SELECT c.doc_id, coalesce(b.n_runs, 0) AS n_runs, b.top.s AS start, b.top.l AS length, b.top.q AS period, 1000 * b.top.l // b.top.q AS exponent_milli,
       sha256(coalesce(b.listed, '')) AS runs_sha256, sha256(coalesce(k.kept, '')) AS collapsed_sha256
FROM cut c LEFT JOIN best b ON b.doc_id = c.doc_id LEFT JOIN kept k ON k.doc_id = c.doc_id
"""

OP12_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, 2.0::DOUBLE * sum(size)::DOUBLE AS most,
         [3.0::DOUBLE, 1.0, 2.0][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS weight
  FROM d GROUP BY source),
rise(step, level) AS (
  SELECT 0, 0.0::DOUBLE
  UNION ALL
  SELECT r.step + 1, (max(t.total) - coalesce(sum(s.most) FILTER (s.weight * r.level > s.most), 0)) / sum(s.weight) FILTER (NOT s.weight * r.level > s.most)
  FROM rise r, s, (SELECT sum(source_size)::DOUBLE * 1.5 AS total FROM s) t WHERE r.step < 30 GROUP BY r.step, r.level),
goal AS (SELECT source, source_size, least(weight * (SELECT level FROM rise WHERE step = 30), most) AS target FROM s),
queued AS (
  SELECT d.doc_id, d.source, d.size, pass, CAST('0x' || substr(md5(pass || ':' || coalesce(CAST(d.doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS place
  FROM d, (VALUES (0), (1)) AS p(pass)),
placed AS (
  SELECT doc_id, source, size, sum(size) OVER (PARTITION BY source ORDER BY pass, place, doc_id ROWS UNBOUNDED PRECEDING) - size AS before FROM queued),
taken AS (
  SELECT p.doc_id, sum(greatest(0, least(p.size, floor(g.target) - p.before))) AS taken
  FROM placed p JOIN goal g ON g.source IS NOT DISTINCT FROM p.source GROUP BY p.doc_id)
SELECT d.doc_id, d.size, g.source_size, g.target, CAST(t.taken AS BIGINT) AS taken
FROM d JOIN goal g ON g.source IS NOT DISTINCT FROM d.source JOIN taken t ON t.doc_id = d.doc_id
"""

OP13_SQL = r"""
WITH d AS (
  SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents),
kept AS (
  SELECT lang, term FROM (SELECT lang, unnest(list_distinct(ts)) AS term FROM d) GROUP BY lang, term HAVING count(*) >= 30),
v AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
grp AS (SELECT DISTINCT lang, source FROM d),
raw AS (SELECT lang, source, term, count(*) AS c FROM (SELECT lang, source, unnest(ts) AS term FROM d) SEMI JOIN kept USING (lang, term) GROUP BY ALL),
full_ AS (SELECT g.lang, g.source, k.term, coalesce(r.c, 0) AS c FROM grp g JOIN kept k ON k.lang = g.lang LEFT JOIN raw r ON r.lang = g.lang AND r.source = g.source AND r.term = k.term),
shares AS (
  SELECT f.lang, source, term, c, 1 + (1000000000::HUGEINT * (c + 5)) // (sum(c) OVER (PARTITION BY f.lang, source) + 5 * v) AS p,
         sum(c) OVER (PARTITION BY f.lang, term) AS lc, sum(c) OVER (PARTITION BY f.lang, source) AS n, v
  FROM full_ f JOIN v ON v.lang = f.lang),
totals AS (SELECT lang, sum(c) AS ln FROM raw GROUP BY lang),
pair AS (
  SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value
  FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (
  SELECT g.lang, g.source, 'pair' AS part, h.source AS item, coalesce(p.value, 0) AS value
  FROM grp g JOIN grp h ON g.lang = h.lang AND g.source <> h.source LEFT JOIN pair p ON p.lang = g.lang AND p.source = g.source AND p.item = h.source),
terms AS (
  SELECT s.lang, source, 'term' AS part, term AS item, p - (1 + (1000000000::HUGEINT * (lc + 5)) // (ln + 5 * v)) AS value, c
  FROM shares s JOIN totals t ON t.lang = s.lang),
both_ AS (
  SELECT lang, source, part, item, value FROM pairs
  UNION ALL SELECT lang, source, part, item, value FROM terms WHERE c > 0 AND value > 0)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
FROM both_ QUALIFY part = 'pair' OR rank <= 50
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_line_dedup": OP2_SQL, "op5_decontamination": OP5_SQL, "op6_exact_dedup": OP6_SQL, "op8_ngram_join": OP8_SQL, "op11_periodic_runs": OP11_SQL, "op12_mixing": OP12_SQL, "op13_divergence": OP13_SQL}
