"""One query for each corpus operator, over its whole table, and the SQL that some are held against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumen3d.llm.common import LOWER, UPPER, read
from lumen3d.llm.embedding_dedup import near_vectors
from lumen3d.llm.exact_dedup import exact_dedup
from lumen3d.llm.line_dedup import dedup_lines
from lumen3d.llm.mixing import mix_sources
from lumen3d.llm.near_dedup import near_duplicates
from lumen3d.llm.packing import pack_documents
from lumen3d.llm.quality import fit_quality, held_out, score_quality
from lumen3d.llm.secret_scan import BASE, joined, secret_scan
from lumen3d.llm.sharding import shard_documents
from lumen3d.llm.substring_dedup import remove_recurring

#: Documents that score less are rejected.
QUALITY = 0.7


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(read(spark, sf_dir, "documents"), keep="largest")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(read(spark, sf_dir, "documents"), tokenizer_path(), capacity=4096, end_id=1)


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"), width=4, threshold=0.8)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    scored = score_quality(docs, fit_quality(docs, read(spark, sf_dir, "labels")))
    return scored.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= QUALITY).cast("int").alias("predicted"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(read(spark, sf_dir, "documents"), weights=(5, 2, 1), cap=3).select("doc_id", "size", "source_size", "target", "taken")


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = shard_documents(read(spark, sf_dir, "documents"), n_shards=24)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = remove_recurring(read(spark, sf_dir, "documents"), width=35)
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = dedup_lines(read(spark, sf_dir, "documents"), threshold=0.8)
    return kept.select("doc_id", "n_lines", F.col("n_removed_lines").alias("n_removed"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan(read(spark, sf_dir, "documents"))
    base = F.filter("found", lambda s: s["kind"].isin(*[r.kind for r in BASE]))
    of = lambda kind: lambda s: s["kind"] == kind
    counts = [F.size(F.filter("found", of(r.kind))).cast("long").alias(f"n_{r.kind}") for r in BASE]
    return found.select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("found")).alias("spans"))


def op10_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(read(spark, sf_dir, "embeddings"), threshold=0.93)


# The SQL states its constants, patterns and orders by itself, from the queries' definitions.

# Kind, pattern, group and least length of the group.
_SECRETS = (
    ("assign", r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    ("access", "AKIA[A-Z0-9]+", 0, 18),
    ("hex", "[0-9a-f]+", 0, 16),
    ("pem", "-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 0),
    ("github", "gh[pousr]_[A-Za-z0-9]{36}", 0, 0),
    ("slack", "xox[abprs]-[A-Za-z0-9-]{10,}", 0, 0),
    ("google", "AIza[A-Za-z0-9_-]{35}", 0, 0),
    ("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 0),
)


def _secret_spans(order: int, kind: str, pattern: str, group: int, least: int) -> str:
    """Spans of one rule: cumulative lengths of gaps and matches, as in a scan from the left."""
    pattern = pattern.replace("'", "''")
    return f"""
SELECT doc_id, {order} AS o, '{kind}' AS kind, g + m - n AS start, g + m AS stop, v FROM (
  SELECT doc_id, n, v, sum(gap) OVER w AS g, sum(n) OVER w AS m FROM (
    SELECT doc_id, unnest(range(len(hits))) AS i, unnest([length(x) FOR x IN hits]) AS n, unnest([length(x) FOR x IN vals]) AS v, unnest([length(x) FOR x IN gaps[1:len(hits)]]) AS gap FROM (
      SELECT doc_id, regexp_extract_all(body, '{pattern}') AS hits, regexp_extract_all(body, '{pattern}', {group}) AS vals, string_split_regex(body, '{pattern}') AS gaps FROM t))
  WINDOW w AS (PARTITION BY doc_id ORDER BY i)) WHERE v >= {least}"""


def _secrets_oracle() -> str:
    joined_up = lambda where: f"coalesce(string_agg(kind || ':' || start::BIGINT || ':' || stop::BIGINT, ',' ORDER BY start, o) FILTER ({where}), '')"
    return f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS body FROM documents),
s AS ({" UNION ALL ".join(_secret_spans(i, *rule) for i, rule in enumerate(_SECRETS))}
)
SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
       sha256({joined_up("kind IN ('assign', 'access', 'hex')")}) AS base_sha256, {joined_up("kind IS NOT NULL")} AS spans
FROM t LEFT JOIN s USING (doc_id) GROUP BY doc_id"""


_LOWERED = "translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"

QUERIES = {f.__name__: f for f in (op1_exact_dedup, op2_packing, op3_near_dedup, op4_quality, op5_mixing, op6_sharding, op7_substring_dedup, op8_line_dedup, op9_secrets, op10_embedding_dedup)}

ORACLES = {
    "op1_exact_dedup": f"""
WITH t AS (SELECT doc_id, sha256(translate(coalesce(text, ''), '{UPPER}', '{LOWER}')) AS text_sha256 FROM documents),
g AS (SELECT *, max(doc_id) OVER (PARTITION BY text_sha256) AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size FROM t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM g
""",
    "op3_near_dedup": f"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format(_LOWERED.format("text"))} AS ws FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct([array_to_string(ws[i:i + 3], ' ') FOR i IN range(1, len(ws) - 2)]) END AS sh FROM w),
g AS (SELECT doc_id, len(sh) AS n, sh, CASE WHEN len(sh) > 0 THEN sha256(array_to_string(list_sort(sh), chr(10))) END AS k FROM s),
r AS (SELECT k, min(doc_id) AS id, any_value(n) AS n, any_value(sh) AS sh FROM g WHERE k IS NOT NULL GROUP BY k),
e AS (SELECT k, n, unnest(sh) AS x FROM r),
p AS (
  SELECT a.k AS a, b.k AS b FROM e a JOIN e b ON a.x = b.x AND a.k < b.k AND 100 * a.n >= 80 * b.n AND 100 * b.n >= 80 * a.n
  GROUP BY a.k, b.k, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
l AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
reach AS (SELECT k, id FROM r UNION SELECT l.b, reach.id FROM reach JOIN l ON l.a = reach.k),
c AS (SELECT k, min(id) AS component_id FROM reach GROUP BY k)
SELECT doc_id, n AS n_shingles, coalesce(component_id, doc_id) AS component_id, doc_id = coalesce(component_id, doc_id) AS kept FROM g LEFT JOIN c ON c.k = g.k
""",
    "op5_mixing": f"""
WITH t AS (
  SELECT doc_id, source, len({_WORDS.format("coalesce(text, '')")}) AS size,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || coalesce(text, '')), 1, 15) AS BIGINT) AS h FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM t GROUP BY source),
w AS (SELECT *, [5.0, 2.0, 1.0][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3]::DOUBLE AS weight, 3.0::DOUBLE * source_size AS most FROM s),
l AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(most) OVER (ORDER BY most / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (ORDER BY most / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
g AS (
  SELECT source, source_size, least(most, max(level) OVER () * weight) AS target,
         CAST('0x' || substr(md5(CASE WHEN source IS NULL THEN '0:false:' ELSE '0:true:' || source END), 1, 15) AS BIGINT) / 1152921504606846976.0::DOUBLE AS u FROM l),
r AS (
  SELECT t.*, source_size, target, u, coalesce(target / nullif(source_size, 0), 0.0) AS rate,
         row_number() OVER (PARTITION BY t.source ORDER BY length(bin(size)) * 64 + (size >> greatest(length(bin(size)) - 6, 0)), h, doc_id, size) AS k
  FROM t JOIN g ON t.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target, CAST(size * least(floor(k * rate + u) - floor((k - 1) * rate + u), 3) AS BIGINT) AS taken FROM r
""",
    "op7_substring_dedup": f"""
WITH w AS (SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS ws FROM documents),
p AS (SELECT doc_id, i, ws[i] AS word, CASE WHEN i + 34 <= len(ws) THEN md5(array_to_string(ws[i:i + 34], ' ')) END AS h FROM (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM w)),
n AS (SELECT h FROM p WHERE h IS NOT NULL GROUP BY h HAVING count(*) > 1),
x AS (SELECT doc_id, i, word, coalesce(max(CASE WHEN n.h IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 34 PRECEDING AND CURRENT ROW), 0) AS gone FROM p LEFT JOIN n ON n.h = p.h),
d AS (SELECT doc_id, count(*) AS n_words, sum(gone) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (gone = 0) AS kept FROM x GROUP BY doc_id)
SELECT w.doc_id, coalesce(n_words, 0) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN d USING (doc_id)
""",
    "op8_line_dedup": f"""
WITH t AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents),
l AS (SELECT doc_id, unnest(range(len(parts))) AS i, unnest(parts) AS line FROM t),
o AS (SELECT *, list_sort(list_distinct({_WORDS.format(_LOWERED.format("line"))})) AS s, row_number() OVER (ORDER BY doc_id, i) AS k FROM l),
g AS (SELECT s, min(k) AS f, len(s) AS n FROM o WHERE len(s) > 0 GROUP BY s),
x AS (SELECT f, n, unnest(s) AS x FROM g),
c AS (SELECT x, count(*) AS c FROM x GROUP BY x),
e AS (SELECT f, n, x FROM x JOIN c USING (x) QUALIFY row_number() OVER (PARTITION BY f ORDER BY c, x) <= n - (4 * n + 4) // 5 + 1),
p AS (SELECT DISTINCT a.f AS a, b.f AS b FROM e a JOIN e b ON a.x = b.x AND a.f < b.f AND 5 * a.n >= 4 * b.n AND 5 * b.n >= 4 * a.n),
z AS (SELECT DISTINCT b FROM (SELECT p.b, len(list_intersect(ga.s, gb.s)) AS m, ga.n + gb.n AS n FROM p JOIN g ga ON ga.f = a JOIN g gb ON gb.f = b) WHERE 5 * m >= 4 * (n - m)),
q AS (SELECT doc_id, i, line, len(o.s) = 0 OR (o.k = g.f AND z.b IS NULL) AS stays FROM o LEFT JOIN g ON g.s = o.s LEFT JOIN z ON z.b = g.f)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (NOT stays) AS n_removed, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (stays), '')) AS kept_sha256 FROM q GROUP BY doc_id
""",
    "op9_secrets": _secrets_oracle(),
    "op10_embedding_dedup": """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a),
reach AS (SELECT vec_id AS k, vec_id AS id FROM v UNION SELECT l.b, reach.id FROM reach JOIN l ON l.a = reach.k),
c AS (SELECT k, min(id) AS component_id FROM reach GROUP BY k)
SELECT vec_id, coalesce(n, 0) AS n_links, coalesce(component_id, vec_id) AS component_id, vec_id = coalesce(component_id, vec_id) AS kept
FROM embeddings LEFT JOIN n ON a = vec_id LEFT JOIN c ON k = vec_id
""",
}
