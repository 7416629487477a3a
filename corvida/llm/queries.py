"""Queries of this package for the driver; each returns the columns of its contract."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvida.llm import bpe, decontam, embeddings, hardneg, licenses, linededup, pagetext, periodic, quality, simhash, tokencount, toxicity, urlfilter
from corvida.sources.tables import table

BYTE_VOCABULARY = "byte_bpe_multi_50k.tiktoken"
PIECE_VOCABULARY = "piece_bpe_32k.model"


def fold(modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; -1 for a null id."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus, F.lit(-1))


def op1_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and notices of all documents."""
    return licenses.license_scan(table(spark, sf_dir, "documents"))


def _op1_sql() -> str:
    word = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
    text = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    quoted = lambda words: "[" + ", ".join(f"'{w}'" for w in words) + "]"
    phrases = "[" + ", ".join(f"{{'label': '{t.label}', 'words': {quoted(t.words)}}}" for t in licenses.templates() if t.whole_text) + "]"
    notices = "[" + ", ".join(f"{{'label': '{t.label}', 'words': {quoted(sorted(set(t.words)))}, 'need': {t.need}, 'n': {t.window}}}" for t in licenses.templates() if not t.whole_text) + "]"
    return f"""
WITH d AS (SELECT doc_id, {text} AS t FROM documents),
w AS (SELECT doc_id, regexp_extract_all(t, '{word}') AS ws FROM d),
places AS (SELECT doc_id, p.label, i - 1 AS pos FROM w, unnest({phrases}) AS u(p), unnest(generate_series(1, len(ws))) AS g(i)
  WHERE ws[i] = p.words[1] AND ws[i:i + len(p.words) - 1] = p.words),
base AS (SELECT doc_id, count(*) AS n_base, min(pos) AS first_word, max(pos) AS last_word FROM places GROUP BY doc_id),
lines AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d),
notices AS (SELECT unnest({notices}) AS n),
blocks AS (SELECT * FROM (SELECT doc_id, n, regexp_extract_all(line, '{word}') AS ws FROM lines, notices) WHERE len(ws) <= 2 * n.n
  UNION ALL SELECT doc_id, n, ws[i * n.n + 1:i * n.n + 2 * n.n] FROM w JOIN notices ON len(list_intersect(ws, n.words)) >= n.need, unnest(generate_series(0, (len(ws) - 1) // n.n)) AS g(i)),
met AS (SELECT doc_id, n.label, max(len(list_intersect(ws, n.words)) / CAST(len(n.words) AS DOUBLE)) AS c FROM blocks
  WHERE len(list_intersect(ws, n.words)) >= n.need GROUP BY doc_id, n.label),
best AS (SELECT doc_id, max(c) AS c FROM met GROUP BY doc_id),
said AS (SELECT doc_id, label, true AS base FROM places UNION SELECT doc_id, label, false FROM met),
texts AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE base) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM said GROUP BY doc_id)
SELECT w.doc_id, len(ws) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
  CASE WHEN n_base > 0 THEN CAST(1 AS DOUBLE) ELSE coalesce(c, 0) END AS score
FROM w LEFT JOIN base USING (doc_id) LEFT JOIN best USING (doc_id) LEFT JOIN texts USING (doc_id)"""


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of all documents; the model is fitted outside the held-out fold."""
    docs = table(spark, sf_dir, "documents")
    scored = quality.score(docs, quality.fit(docs, table(spark, sf_dir, "labels"), "quality", fold(3) != 1))
    return scored.select("doc_id", (fold(3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What line dedup leaves of every document."""
    done = linededup.dedup_lines(table(spark, sf_dir, "documents"))
    return done.select(F.col("r.doc_id").alias("doc_id"), F.col("n_lines").cast("long").alias("n_lines"), F.col("n_deleted").cast("long").alias("n_deleted"), F.sha2("kept_text", 256).alias("kept_sha256"))


OP3_SQL = f"""
WITH docs AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
lines AS (SELECT doc_id, i - 1 AS n, ls[i] AS line, len(regexp_extract_all(ls[i], '[^ \\t\\n\\x0B\\f\\r]+')) AS words
  FROM docs, unnest(generate_series(1, len(ls))) AS t(i)),
matches AS (SELECT a.doc_id AS da, a.n AS na, b.doc_id AS db, a.n - b.n AS shift, a.words
  FROM lines a JOIN lines b ON a.line = b.line AND (b.doc_id < a.doc_id OR (b.doc_id = a.doc_id AND b.n < a.n))),
diagonals AS (SELECT *, na - row_number() OVER (PARTITION BY da, db, shift ORDER BY na) AS stretch FROM matches),
runs AS (SELECT da, min(na) AS s, max(na) AS e FROM diagonals GROUP BY da, db, shift, stretch HAVING sum(words) >= {linededup.MIN_WORDS} OR count(*) FILTER (WHERE words > 0) >= {linededup.MIN_LINES}),
deleted AS (SELECT DISTINCT da, n FROM runs, unnest(generate_series(s, e)) AS t(n))
SELECT l.doc_id, count(*) AS n_lines, count(d.da) AS n_deleted,
  sha256(coalesce(string_agg(l.line, chr(10) ORDER BY l.n) FILTER (WHERE d.da IS NULL), '')) AS kept_sha256
FROM lines l LEFT JOIN deleted d ON d.da = l.doc_id AND d.n = l.n GROUP BY l.doc_id
"""


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unigram piece counts of all documents."""
    pieces = tokencount.read_pieces(public_tokenizers.path(PIECE_VOCABULARY))
    return tokencount.count_tokens(table(spark, sf_dir, "documents"), pieces)


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash groups of all documents."""
    groups = simhash.simhash_groups(table(spark, sf_dir, "documents"))
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules and link-graph verdicts of all pages."""
    return urlfilter.judge(table(spark, sf_dir, "pages"))


def _op6_sql() -> str:
    host = lambda url: f"translate(coalesce(regexp_extract({url}, '^(?s:.*?)://([^/?#]*)', 1), ''), '{urlfilter.UPPER}', '{urlfilter.LOWER}')"
    covers = lambda rule, h: f"({h} = '{rule.partition('/')[0]}' OR ends_with({h}, '.{rule.partition('/')[0]}'))"
    by_length = sorted(urlfilter.RULES, key=lambda r: (-len(r[0]), r[0]))
    rule = "CASE " + " ".join(f"WHEN {covers(r, 'host')} AND starts_with(path, '/{r.partition('/')[2]}') THEN '{r}'" for r, _ in by_length) + " END"
    own = "CASE rule " + " ".join(f"WHEN '{r}' THEN '{v}'" for r, v in urlfilter.RULES) + " END"
    trusted = " OR ".join(covers(r, "host") for r, v in urlfilter.RULES if v == "allow")
    blocked = " OR ".join(covers(r, "host") for r, v in urlfilter.RULES if v == "block" and r.endswith("/") and r.count("/") == 1)
    damping = f"CAST({urlfilter.DAMPING} AS DOUBLE)"
    return f"""
WITH RECURSIVE rows AS (SELECT page_id, html, {host('url')} AS host, coalesce(regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
links AS (SELECT host AS src, unnest(regexp_extract_all(regexp_replace(html, '{urlfilter.COMMENT}', '', 'g'), '{urlfilter.HREF.replace("'", "''")}', 1)) AS link FROM rows),
targets AS (SELECT src, {host("CASE WHEN starts_with(link, '//') THEN 'http:' || link ELSE link END")} AS dst FROM links WHERE contains(link, '//')),
edges AS (SELECT src, dst, count(*) AS n FROM targets WHERE src != '' AND dst != '' AND src != dst GROUP BY src, dst),
moves AS (SELECT 0 AS kind, src AS host, dst AS target, {damping} * n / sum(n) OVER (PARTITION BY src) AS share FROM edges
  UNION ALL SELECT 1, dst, src, {damping} * n / sum(n) OVER (PARTITION BY dst) FROM edges),
nodes AS (SELECT host FROM rows UNION SELECT dst FROM edges),
seeds AS (SELECT 0 AS kind, host FROM nodes WHERE {trusted} UNION ALL SELECT 1, host FROM nodes WHERE {blocked}),
walk AS (SELECT kind, host, CAST(1 AS DOUBLE) / count(*) OVER (PARTITION BY kind) AS mass FROM seeds
  UNION ALL SELECT w.kind, m.target, sum(w.mass * m.share) FROM (SELECT *, sum(mass) OVER () AS all_mass FROM walk) w JOIN moves m ON m.kind = w.kind AND m.host = w.host WHERE w.all_mass > 1e-12 GROUP BY w.kind, m.target),
scores AS (SELECT host, coalesce(sum(mass) FILTER (WHERE kind = 0) / (SELECT sum(mass) FROM walk WHERE kind = 0), 0) AS t,
  coalesce(sum(mass) FILTER (WHERE kind = 1) / (SELECT sum(mass) FROM walk WHERE kind = 1), 0) AS d FROM walk GROUP BY host),
ruled AS (SELECT page_id, host, path, {rule} AS rule FROM rows)
SELECT page_id, host, path, rule, CASE WHEN rule IS NOT NULL THEN {own} WHEN s.d > {urlfilter.RATIO} * (1 + {urlfilter.ROUNDING}) * s.t THEN 'block' ELSE 'allow' END AS verdict
FROM ruled LEFT JOIN scores s USING (host)"""


def toxicity_model(spark: SparkSession, sf_dir: str) -> toxicity.Model:
    """Fitted on the labelled rows outside the held-out fold."""
    return toxicity.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "toxic", fold(4) != 2)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all documents."""
    scored = toxicity.score(table(spark, sf_dir, "documents"), toxicity_model(spark, sf_dir))
    return scored.select("doc_id", (fold(4) == 2).alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def op8_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every overlap of a document with a benchmark item."""
    return decontam.contaminated_spans(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def byte_vocabulary() -> dict[bytes, int]:
    return bpe.read_ranks(public_tokenizers.path(BYTE_VOCABULARY))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte-level BPE of all documents, there and back."""
    return bpe.encode_texts(table(spark, sf_dir, "documents"), byte_vocabulary(), public_tokenizers.PATTERN)


def op10_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate classes of all vectors."""
    found = embeddings.near_duplicates(table(spark, sf_dir, "embeddings"))
    return found.withColumn("kept", F.col("vec_id") == F.col("component_id"))


OP10_SQL = f"""
WITH RECURSIVE v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x != 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id != b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= {embeddings.THRESHOLD}),
reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
least_of AS (SELECT a, min(b) AS low FROM reach GROUP BY a),
counts AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, least(vec_id, coalesce(low, vec_id)) AS component_id, least(vec_id, coalesce(low, vec_id)) = vec_id AS kept
FROM embeddings LEFT JOIN counts c ON c.a = vec_id LEFT JOIN least_of m ON m.a = vec_id
"""


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every hundredth vector; some labels are moved on by one first."""
    rows = table(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hardneg.hard_negatives(rows.withColumn("label", moved), F.col("vec_id") % 100 == 0, scale=256.0)


OP11_SQL = f"""
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (SELECT a.vec_id AS a, b.vec_id AS b, a.label = b.label AS same, CAST(list_inner_product(a.e, b.e) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id != b.vec_id AND len(a.e) = len(b.e)),
positives AS (SELECT * FROM pairs WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, b) <= {hardneg.POSITIVES})
SELECT p.a AS anchor_id, p.b AS positive_id, CAST(row_number() OVER (PARTITION BY p.a, p.b ORDER BY n.score DESC, n.b) AS INTEGER) AS rank, n.b AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM positives p JOIN pairs n ON n.a = p.a AND NOT n.same AND {hardneg.WINDOW[0]} * p.score <= 100 * n.score AND 100 * n.score <= {hardneg.WINDOW[1]} * p.score
QUALIFY row_number() OVER (PARTITION BY p.a, p.b ORDER BY n.score DESC, n.b) <= {hardneg.NEGATIVES}"""


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of all documents; in a tenth of them the words repeat from some place on."""
    docs, h = table(spark, sf_dir, "documents"), F.crc32(F.col("doc_id").cast("string").cast("binary"))
    repeats = F.when(h % 10 == 0, periodic.words_repeated_from(F.col("text"), F.floor(h / 10))).otherwise(F.col("text"))
    best, line = periodic.highest_run(F.col("runs")), lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])
    return periodic.periodic_runs(docs.select("doc_id", repeats.alias("text"))).withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period", F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", lambda r: F.concat(line(r), F.lit("\n"))), ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


def op13_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of all pages."""
    return pagetext.main_texts(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_licenses, op2_quality, op3_line_dedup, op4_token_counts, op5_simhash, op6_url_filter, op7_toxicity, op8_decontam, op9_bpe, op10_embeddings, op11_hard_negatives, op12_periodic_runs, op13_html)
}
SQL: dict[str, str] = {"op1_licenses": _op1_sql(), "op3_line_dedup": OP3_SQL, "op6_url_filter": _op6_sql(), "op10_embeddings": OP10_SQL, "op11_hard_negatives": OP11_SQL}
