"""The registered queries of the corpus operators, with SQL where SQL can state the result."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import arrow_ids, audit, bagminhash, decontaminate, exact, linejoin, packing, parsing, quality, shard, suffix, vafile, warc
from tidemark.llm.common import documents
from tidemark.plans.registry import Query

QUERIES: dict[str, Query] = {}
CHECKS: dict[str, str] = {}

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


def query(name: str, sql: str | None = None):
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            CHECKS[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


REPEATS_SQL = """
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents
), s AS (
  SELECT doc_id, unnest(range(1, len(w) - 48)) AS i, w FROM d WHERE len(w) >= 50
), h AS (
  SELECT doc_id, i, md5(array_to_string(list_slice(w, i, i + 49), ' ')) AS h FROM s
), dup AS (
  SELECT doc_id, i FROM (SELECT *, min(doc_id) OVER (PARTITION BY h) AS m FROM h) WHERE m < doc_id
), c AS (
  SELECT DISTINCT doc_id, i + j AS i FROM dup, (SELECT unnest(range(0, 50)) AS j)
), k AS (
  SELECT doc_id, list(i) AS gone FROM c GROUP BY doc_id
), r AS (
  SELECT d.doc_id, len(w) AS n_words, coalesce(len(gone), 0) AS n_removed,
    CASE WHEN gone IS NULL THEN w ELSE list_filter(w, lambda x, i: NOT list_contains(gone, i)) END AS kept
  FROM d LEFT JOIN k USING (doc_id)
)
SELECT doc_id, n_words, n_removed, sha256(coalesce(array_to_string(kept, ' '), '')) AS kept_sha256 FROM r
"""


@query("op1_substring_dedup", REPEATS_SQL)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.remove_repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


WARC_SQL = """
WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS bytes, sha256(coalesce(html, '')) AS h FROM pages
), r AS (
  SELECT *, CASE WHEN bytes >= 100 THEN min(page_id) OVER (PARTITION BY h) ELSE page_id END AS head FROM p
)
SELECT page_id, bytes AS payload_bytes, h AS payload_digest, CASE WHEN head = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN head <> page_id THEN head END AS refers_to
FROM r
"""


@query("op2_warc", WARC_SQL)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = warc.write_archives(table(spark, sf_dir, "pages"))
    records = warc.read_archives(spark, manifest).filter("kind = 'record'")
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


LINES_SQL = r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 AS i FROM documents
), t AS (
  SELECT doc_id, i, list_sort(list_distinct(list_filter(regexp_split_to_array(line, '[\x20\x09-\x0D]+'), lambda x: x <> ''))) AS s FROM l
), f AS (
  SELECT doc_id, i, s, min((doc_id, i)) OVER (PARTITION BY s) AS head FROM t WHERE len(s) > 0
), g AS (
  SELECT row_number() OVER () AS g, s, head, len(s) AS n FROM (SELECT DISTINCT s, head FROM f)
), w AS (
  SELECT g, n, unnest(s) AS w FROM g
), p AS (
  SELECT a.g AS a, b.g AS b FROM w a JOIN w b ON a.w = b.w AND a.g < b.g AND a.n * 5 >= b.n * 4 AND b.n * 5 >= a.n * 4
  GROUP BY a.g, b.g, a.n, b.n HAVING count(*) * 5 >= (a.n + b.n - count(*)) * 4
), z AS (
  SELECT DISTINCT CASE WHEN x.head < y.head THEN y.s ELSE x.s END AS s FROM p JOIN g x ON x.g = p.a JOIN g y ON y.g = p.b
), r AS (
  SELECT doc_id, i, z.s IS NOT NULL AS near FROM f LEFT JOIN z USING (s) WHERE z.s IS NOT NULL OR (doc_id, i) <> head
), k AS (
  SELECT doc_id, count(*) AS n_removed, count(*) FILTER (near) AS n_near, string_agg(CAST(i AS VARCHAR), ',' ORDER BY i) AS gone FROM r GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(string_split(coalesce(text, ''), chr(10))) AS BIGINT) AS n_lines, coalesce(n_removed, 0) AS n_removed, coalesce(n_near, 0) AS n_near,
  coalesce(gone, '') AS removed_lines
FROM documents d LEFT JOIN k USING (doc_id)
"""


@query("op3_line_dedup", LINES_SQL)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = linejoin.repeated_lines(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_removed", "n_near", F.array_join("removed_lines", ",").alias("removed_lines"))


@query("op4_bagminhash")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bagminhash.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "class_size", "n_links")


@query("op5_decontaminate")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


EXACT_SQL = """
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS points, sha256(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', '', 'g')) AS h FROM documents
), r AS (
  SELECT *, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY h) AS n, row_number() OVER w AS place
  FROM d WINDOW w AS (PARTITION BY h ORDER BY points DESC, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)
)
SELECT doc_id, keep_id, n AS group_size, place = 1 AS kept, h AS text_sha256 FROM r
"""


@query("op6_exact_dedup", EXACT_SQL)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The older half of the id range is the snapshot, the newer half (and rows without an id) the batch."""
    docs = table(spark, sf_dir, "documents")
    middle = docs.agg(F.floor((F.min("doc_id") + F.max("doc_id")) / 2)).first()[0]
    is_old = F.coalesce(F.col("doc_id") <= F.lit(middle), F.lit(False))
    return exact.deduplicate(docs.filter(is_old), docs.filter(~is_old))


@query("op7_histogram_sort")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Law `bytes`; equal texts share a key, so they are neighbours in the sort."""
    docs = documents(table(spark, sf_dir, "documents"))
    rows = docs.select(
        "doc_id", (F.octet_length("text") + 1).cast("long").alias("size"), F.crc32(F.col("text")).alias("text_crc32"), F.xxhash64("text").alias("text_key")
    )
    sorted_rows = shard.histogram_sort(rows, F.col("text_key"), F.col("doc_id"), F.col("size"), shards=8)
    return sorted_rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@query("op8_nb_svm")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op9_best_fit_packing")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), VOCABULARY)


@query("op10_arrow_ids")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = arrow_ids.write_ids(table(spark, sf_dir, "documents"), VOCABULARY)
    return arrow_ids.read_documents(spark, manifest)


BYTES_SQL = """
WITH d AS (
  SELECT doc_id, encode(coalesce(text, '')) AS b, octet_length(encode(coalesce(text, ''))) AS n FROM documents
), h AS (
  SELECT doc_id, i, md5(b[i:i + 99]) AS h FROM (SELECT doc_id, b, unnest(range(1, n - 98)) AS i FROM d WHERE n >= 100)
), e AS (
  SELECT doc_id, i FROM (SELECT *, row_number() OVER (PARTITION BY h ORDER BY doc_id, i) AS r FROM h) WHERE r > 1
), g AS (
  SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS g
  FROM (SELECT *, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 100 THEN 0 ELSE 1 END AS new FROM e)
), s AS (
  SELECT doc_id, min(i) AS a, max(i) + 99 AS z FROM g GROUP BY doc_id, g
), k AS (
  SELECT doc_id, coalesce(lag(z) OVER w + 1, 1) AS a, a - 1 AS z FROM s WINDOW w AS (PARTITION BY doc_id ORDER BY a)
  UNION ALL SELECT doc_id, max(z) + 1, n FROM s JOIN d USING (doc_id) GROUP BY doc_id, n
), t AS (
  SELECT doc_id, unhex(coalesce(string_agg(hex(b[a:z]), '' ORDER BY a) FILTER (z >= a), '')) AS kept FROM k JOIN d USING (doc_id) GROUP BY doc_id
), c AS (
  SELECT doc_id, CAST(sum(z - a + 1) AS BIGINT) AS n_removed, count(*) AS n_spans FROM s GROUP BY doc_id
)
SELECT doc_id, n AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(coalesce(kept, b)) AS kept_sha256
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id)
"""


@query("op11_prefix_free_parsing", BYTES_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parsing.remove_repeated_bytes(table(spark, sf_dir, "documents")).drop("removed")


def _kmeans_sql(rounds: int) -> str:
    """Rounds written out, as SQL cannot repeat a grouped step."""
    parts = ["""
WITH e AS (
  SELECT vec_id, embedding AS x FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda y: y IS NOT NULL AND isfinite(y))) = 64
), v AS (
  SELECT vec_id, list_transform(x, lambda y: CAST(floor(256 * CAST(y AS DOUBLE)) AS BIGINT)) AS x FROM e
), c0 AS (
  SELECT CAST(row_number() OVER (ORDER BY sha256('2:' || vec_id)) - 1 AS INTEGER) AS c, x FROM v ORDER BY sha256('2:' || vec_id) LIMIT 40
)"""]
    for r in range(rounds + 1):
        parts.append(f""", a{r} AS (
  SELECT vec_id, x, z.c AS c, z.d AS d FROM (
    SELECT v.vec_id, v.x, min({{'d': list_sum(list_transform(list_zip(v.x, c.x), lambda p: (p[1] - p[2]) * (p[1] - p[2]))), 'c': c.c}}) AS z
    FROM v CROSS JOIN c{r} c GROUP BY v.vec_id, v.x)
)""")
        if r < rounds:
            parts.append(f""", m{r} AS (
  SELECT c, list(m ORDER BY j) AS x FROM (
    SELECT c, j, (sum(y) - (sum(y) % count(*) + count(*)) % count(*)) // count(*) AS m
    FROM (SELECT c, unnest(x) AS y, generate_subscripts(x, 1) AS j FROM a{r}) GROUP BY c, j) GROUP BY c
), c{r + 1} AS (
  SELECT c, coalesce(m.x, o.x) AS x FROM c{r} o LEFT JOIN m{r} m USING (c)
)""")
    parts.append(f"""
SELECT vec_id, c AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia,
  CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(f.x, ',')) AS centroid_sha256
FROM a{rounds} JOIN c{rounds} f USING (c)
""")
    return "".join(parts)


@query("op12_va_file", _kmeans_sql(vafile.ROUNDS))
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vafile.cluster(table(spark, sf_dir, "embeddings"))


AUDIT_SQL = r"""
WITH RECURSIVE o(filter_order) AS (
  SELECT '' UNION ALL SELECT filter_order || f FROM o, (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f) WHERE NOT contains(filter_order, f)
), w AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t,
    list_filter(regexp_split_to_array(coalesce(text, ''), '[ 	-]+'), lambda x: x <> '') AS w FROM documents
), m AS (
  SELECT doc_id, part, CASE WHEN len(w) < 200 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 'B' ELSE '' END
    || CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t) THEN 'C' ELSE '' END
    || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END
    || CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 'E' ELSE '' END AS fails
  FROM w
), c AS (
  SELECT part, fails, count(*) AS n, count(*) FILTER (quality = 1) AS good, count(*) FILTER (toxic = 1) AS toxic FROM m LEFT JOIN labels USING (doc_id) GROUP BY part, fails
), s AS (
  SELECT filter_order, CAST(step AS INTEGER) AS step, substr(filter_order, step, 1) AS f, substr(filter_order, 1, step - 1) AS before
  FROM o, (SELECT unnest(range(1, 6)) AS step) WHERE length(filter_order) = 5
), x AS (
  SELECT part, filter_order, step, f, n, good, toxic, fails, contains(fails, f) AS hit,
    length(before) > 0 AND length(translate(fails, before, '')) < length(fails) AS gone FROM s, c
), r AS (
  SELECT part, filter_order, step, f, CAST(coalesce(sum(n) FILTER (NOT hit AND NOT gone), 0) AS BIGINT) AS kept,
    CAST(coalesce(sum(n) FILTER (hit AND NOT gone), 0) AS BIGINT) AS removed, CAST(coalesce(sum(n) FILTER (hit AND gone), 0) AS BIGINT) AS redundant,
    CAST(coalesce(sum(n) FILTER (fails = f), 0) AS BIGINT) AS unique_fails, CAST(coalesce(sum(good) FILTER (hit AND NOT gone), 0) AS BIGINT) AS good_lost,
    CAST(coalesce(sum(toxic) FILTER (hit AND NOT gone), 0) AS BIGINT) AS toxic_lost
  FROM x GROUP BY part, filter_order, step, f
)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley FROM r
"""


@query("op13_filter_audit", AUDIT_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
