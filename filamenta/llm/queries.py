"""The queries over the training-text tables, each with its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from filamenta.llm import adaptive_join, cover_tree, lsh_forest, mixing, ngram_trie, packing, repair, secrets, simhash, threshold_search, toxicity, urls, wrappers
from filamenta.session import table


def op1_lsh_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty nearest found for every twentieth vector."""
    return lsh_forest.neighbours(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0, 20)


def op2_cover_tree_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five highest integer inner products of every fiftieth vector with all others."""
    return cover_tree.top_k(table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0, 5)


def op3_wrapper_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page, by its host's wrapper."""
    return wrappers.extracted(table(spark, sf_dir, "pages"))


def op4_ngram_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log-probabilities of every document under the n-gram model of those that are not held out."""
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2
    return ngram_trie.scored(table(spark, sf_dir, "documents"), held_out)


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, rule and verdict of every page."""
    return urls.judged(table(spark, sf_dir, "pages"))


def op6_raked_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's probability of being kept under the raked weights, and the draw."""
    out = mixing.mixed(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.round("keep_probability", 6).alias("keep_probability"), "kept")


def op7_simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every document."""
    out = simhash.near_duplicate_components(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, by models that do not see the held-out documents' labels."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    model = toxicity.fitted(docs, labels.where(~held_out))
    out = toxicity.scored(docs.select("doc_id", "text"), model)
    return out.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op9_swap_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequences of at most 4096 tokens that hold every document."""
    return packing.packed_documents(table(spark, sf_dir, "documents"))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of secrets in every document."""
    return secrets.scan_report(table(spark, sf_dir, "documents"))


def op11_threshold_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fifty highest-scoring documents for every benchmark item."""
    return threshold_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), 50)


def damaged(rows: DataFrame) -> DataFrame:
    """The faults that the repair query plants, by the row's own number: a turn dropped, emptied, cut, repeated, or given to the user."""
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    way = F.crc32(F.concat(said("conv_id"), F.lit(":"), said("turn")).cast("binary")) % 20
    r = rows.select("conv_id", "turn", said("role").alias("role"), said("text").alias("text"), way.alias("way")).where("way <> 0")
    r = r.withColumn("copy", F.explode(F.array_repeat(F.lit(1), F.when(F.col("way") == 3, 2).otherwise(1))))
    text = F.when(F.col("way") == 1, "").when(F.col("way") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    return r.select("conv_id", "turn", F.when(F.col("way") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"))


def op12_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults, least edits and the digest of the repaired turns of every damaged conversation."""
    rows = table(spark, sf_dir, "conversations")
    found = repair.audited(damaged(rows)).withColumnRenamed("conv_id", "id")
    every = rows.select("conv_id").distinct().join(found, F.col("conv_id").eqNullSafe(F.col("id")), "left")
    counts = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return every.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))


def op13_adaptive_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shingle count and component of every document, linked at a Jaccard similarity of 0.85."""
    return adaptive_join.components(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_lsh_forest,
        op2_cover_tree_top_k,
        op3_wrapper_text,
        op4_ngram_trie,
        op5_url_filter,
        op6_raked_mixture,
        op7_simhash_components,
        op8_toxicity,
        op9_swap_packing,
        op10_secret_scan,
        op11_threshold_search,
        op12_turn_repair,
        op13_adaptive_join,
    )
}

_RULES_SQL = " UNION ALL ".join(f"SELECT '{v}' AS v, '{h}' AS h, '{p}' AS p" for v, h, p in urls.RULES)
_URL_SQL = r"""
WITH RECURSIVE rules AS ({rules}),
own AS (
  SELECT page_id, url, html,
    CASE WHEN url LIKE '%://%' THEN translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), '{up}', '{low}') ELSE '' END AS host,
    CASE WHEN url LIKE '%://%' THEN regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1) ELSE '' END AS path
  FROM pages),
fitted AS (
  SELECT page_id, url, html, host, path,
    (SELECT max_by(struct_pack(v := v, r := h || p), length(h || p)) FROM rules WHERE (own.host = h OR ends_with(own.host, '.' || h)) AND starts_with(own.path, p)) AS fit
  FROM own),
links AS (
  SELECT host || CASE WHEN path = '' THEN '/' ELSE path END || regexp_extract(url, '(?s)^.*?://[^/?#]*[^?#]*(\?[^#]*)', 1) AS a, host, path,
    unnest(regexp_extract_all(html, '(?is)<link\b[^>]*?\brel\s*=\s*["'']?canonical\b[^>]*?\bhref\s*=\s*["'']?([^"''\s>]+)', 1)
      || regexp_extract_all(html, '(?is)<link\b[^>]*?\bhref\s*=\s*["'']?([^"''\s>]+)[^>]*?\brel\s*=\s*["'']?canonical\b', 1)
      || regexp_extract_all(html, '(?is)<meta\b[^>]*?\bhttp-equiv\s*=\s*["'']?refresh\b[^>]*?\burl\s*=\s*["'']?([^"''\s>]+)', 1)) AS link
  FROM fitted WHERE url LIKE '%://%'),
targets AS (
  SELECT a, CASE WHEN link LIKE '%://%' THEN link WHEN starts_with(link, '//') THEN 'http:' || link WHEN starts_with(link, '/') THEN 'http://' || host || link
    WHEN starts_with(link, '?') THEN 'http://' || host || path || link
    ELSE 'http://' || host || CASE WHEN path LIKE '%/%' THEN regexp_extract(path, '(?s)^(.*/)', 1) ELSE '/' END || link END AS t
  FROM links),
parts AS (
  SELECT a, translate(regexp_extract(t, '(?s)^.*?://([^/?#]*)', 1), '{up}', '{low}') AS th, regexp_extract(t, '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS tp, t FROM targets),
edges AS (
  SELECT a, th || CASE WHEN tp = '' THEN '/' ELSE tp END || regexp_extract(t, '(?s)^.*?://[^/?#]*[^?#]*(\?[^#]*)', 1) AS b,
    (SELECT max_by(v, length(h || p)) FROM rules WHERE (th = h OR ends_with(th, '.' || h)) AND starts_with(tp, p)) AS tv
  FROM parts),
nodes AS (
  SELECT page_id, fit, host || CASE WHEN path = '' THEN '/' ELSE path END || regexp_extract(url, '(?s)^.*?://[^/?#]*[^?#]*(\?[^#]*)', 1) AS n FROM fitted WHERE url LIKE '%://%'),
reach(n) AS (
  SELECT n FROM nodes WHERE fit.v = 'block' UNION SELECT b FROM edges WHERE tv = 'block'
  UNION
  SELECT x.b FROM reach JOIN (SELECT a, b FROM edges UNION SELECT b, a FROM edges) x ON reach.n = x.a)
SELECT f.page_id, f.host, f.path, f.fit.r AS rule,
  COALESCE(f.fit.v, CASE WHEN nodes.n IN (SELECT n FROM reach) THEN 'block' ELSE 'allow' END) AS verdict
FROM fitted f LEFT JOIN (SELECT DISTINCT page_id, n FROM nodes) nodes ON f.page_id = nodes.page_id
"""

_TOP_K_SQL = """
WITH z AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS z FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, p.vec_id AS vec_id, CAST(list_sum(list_transform(list_zip(q.z, p.z), lambda x: x[1] * x[2])) AS BIGINT) AS score
  FROM z q JOIN z p ON q.vec_id <> p.vec_id AND q.vec_id % 50 = 0),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""

_TERMS = r"regexp_extract_all(translate(text, '{up}', '{low}'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')".replace("{up}", urls.UPPER).replace("{low}", urls.LOWER)
_LEXICAL_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS t FROM documents),
one AS (SELECT r, doc_id, len(t) AS n, unnest(t) AS term FROM d),
tf AS (SELECT r, term, any_value(doc_id) AS doc_id, any_value(n) AS n, count(*) AS tf FROM one GROUP BY r, term),
whole AS (SELECT count(*) AS docs, CAST(sum(len(t)) AS BIGINT) AS l FROM d WHERE len(t) > 0),
q AS (SELECT DISTINCT item_id, unnest({_TERMS}) AS term FROM benchmark),
df AS (SELECT term, count(*) AS df FROM tf WHERE term IN (SELECT term FROM q) GROUP BY term),
w AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1))) AS BIGINT) AS w FROM df, whole),
x AS (SELECT r, doc_id, term, (1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * docs) // l)) AS impact FROM tf, whole WHERE term IN (SELECT term FROM q)),
s AS (SELECT item_id, r, any_value(doc_id) AS doc_id, CAST(sum(w * impact) AS BIGINT) AS score FROM q JOIN w USING (term) JOIN x USING (term) GROUP BY item_id, r),
o AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank, doc_id, score FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM o WHERE rank <= 50
"""

_WS = "[^\\x20\\x09-\\x0D]"
_REPAIR_SQL = f"""
WITH RECURSIVE o AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations),
h AS (SELECT *, xor(list_reduce(list_transform(string_split(k, ''), lambda c: CAST(ord(c) AS UBIGINT)),
  lambda x, b: list_reduce(range(8), lambda y, i: CASE WHEN y & 1 = 1 THEN xor(y >> 1, 3988292384::UBIGINT) ELSE y >> 1 END, xor(x, b)), 4294967295::UBIGINT), 4294967295::UBIGINT) % 20 AS way FROM o),
d AS (SELECT conv_id, turn, CASE WHEN way = 4 THEN 'user' ELSE role END AS role, CASE way WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE way WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM h WHERE way <> 0),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i, NOT regexp_matches(text, '{_WS}') AS blank FROM d),
f AS (SELECT *, NOT blank AND row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS dup, left(role, 1) AS x, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM n),
g AS (SELECT *, NOT blank AND NOT dup AND NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*\\z') AS cut FROM f),
sums AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (dup) AS duplicate, count(*) FILTER (cut) AS truncated,
  count(*) FILTER (before IS NOT NULL AND before || x NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS rows FROM g GROUP BY conv_id),
put(q, to_q, cost, letters, said) AS (VALUES (0, 0, 0, '', []::VARCHAR[]), (1, 1, 0, '', []), (2, 2, 0, '', []), (3, 3, 0, '', []), (0, 2, 2, 'I', ['user:']), (1, 2, 2, 'I', ['user:']), (2, 3, 2, 'I', ['assistant:']), (3, 2, 2, 'I', ['user:']),
  (0, 3, 4, 'II', ['user:', 'assistant:']), (1, 3, 4, 'II', ['user:', 'assistant:'])),
step(q, x, to_q, letter, cost) AS (VALUES (0, 's', 1, 'K', 0), (0, 'u', 2, 'K', 0), (1, 'u', 2, 'K', 0), (3, 'u', 2, 'K', 0), (2, 'a', 3, 'K', 0), (0, NULL, 2, 'R', 2), (1, NULL, 2, 'R', 2), (3, NULL, 2, 'R', 2), (2, NULL, 3, 'R', 2), (0, NULL, 0, 'D', 3), (1, NULL, 1, 'D', 3), (2, NULL, 2, 'D', 3), (3, NULL, 3, 'D', 3)),
reach(conv_id, i, q, best) AS (
  SELECT conv_id, 0::BIGINT, 0, {{'cost': 0, 'audit': '', 'said': []::VARCHAR[]}} FROM sums
  UNION ALL
  SELECT g.conv_id, g.i, step.to_q, min({{'cost': reach.best.cost + put.cost + step.cost + CASE WHEN g.cut AND step.letter <> 'D' THEN 1 ELSE 0 END, 'audit': reach.best.audit || put.letters || step.letter,
    'said': reach.best.said || put.said || CASE step.letter WHEN 'D' THEN [] WHEN 'K' THEN [g.role || ':' || g.text] ELSE [CASE step.to_q WHEN 2 THEN 'user:' ELSE 'assistant:' END || g.text] END}})
  FROM reach JOIN g ON g.conv_id IS NOT DISTINCT FROM reach.conv_id AND g.i = reach.i + 1 JOIN put ON put.q = reach.q
  JOIN step ON step.q = put.to_q AND (step.x IS NULL OR step.x = g.x) AND (step.letter = 'D' OR NOT (g.blank OR g.dup)) GROUP BY g.conv_id, g.i, step.to_q),
ends AS (SELECT s.conv_id, min({{'cost': best.cost + put.cost, 'audit': best.audit || put.letters, 'said': best.said || put.said}}) AS best FROM sums s JOIN reach ON reach.conv_id IS NOT DISTINCT FROM s.conv_id AND reach.i = s.rows JOIN put ON put.q = reach.q AND put.to_q IN (0, 3) GROUP BY s.conv_id)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  CAST(coalesce(best.cost, 0) AS BIGINT) AS cost, coalesce(best.audit, '') AS audit, sha256(coalesce(array_to_string(best.said, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN sums s ON s.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN ends e ON e.conv_id IS NOT DISTINCT FROM c.conv_id
"""

_JOIN_SQL = """
WITH RECURSIVE w AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(text, '{up}', '{low}'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT r, doc_id, CASE WHEN w IS NULL OR len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
  ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3])) END AS s FROM w),
t AS (SELECT r, unnest(s) AS x FROM s),
p AS (SELECT a.r AS a, b.r AS b, count(*) AS met FROM t a JOIN t b ON a.x = b.x AND a.r < b.r GROUP BY a.r, b.r),
e AS (SELECT a, b FROM p JOIN s x ON x.r = a JOIN s y ON y.r = b WHERE 100 * met >= 85 * (len(x.s) + len(y.s) - met)),
l AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
reach(r, o) AS (SELECT r, r FROM s UNION SELECT reach.r, l.b FROM reach JOIN l ON l.a = reach.o)
SELECT s.doc_id, any_value(CAST(len(s.s) AS BIGINT)) AS n_shingles, min(o.doc_id) AS component_id FROM reach JOIN s USING (r) JOIN s o ON o.r = reach.o GROUP BY s.r, s.doc_id
""".replace("{up}", urls.UPPER).replace("{low}", urls.LOWER).replace("\\\\", "\\")

ORACLE_SQL: dict[str, str] = {
    "op13_adaptive_join": _JOIN_SQL,
    "op12_turn_repair": _REPAIR_SQL,
    "op11_threshold_search": _LEXICAL_SQL,
    "op2_cover_tree_top_k": _TOP_K_SQL,
    "op5_url_filter": _URL_SQL.replace("{rules}", _RULES_SQL).replace("{up}", urls.UPPER).replace("{low}", urls.LOWER).replace("\\\\", "\\"),
}
