"""The registered queries of this subpackage, over whole tables, and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from riskloom.llm import (
    decontaminate, fill_middle, line_dedup, mixing, sharding, simhash, suffix_dedup, token_counts, token_files, toxicity, url_filter, vector_clusters,
    weighted_prints,
)
from riskloom.llm.common import table

QUERIES, ORACLE = {}, {}


def query(build):
    QUERIES[build.__name__] = build
    return build


@query
def op10_simhash_near_dedup(spark, sf_dir):
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hexadecimal(F.col("print")).alias("fingerprint"), "component_id")


def held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def toxicity_model(spark, sf_dir):
    """Trained on the labelled rows that are not held out; rows without doc_id have no label."""
    return toxicity.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), rows=~held_out())


@query
def op7_toxicity(spark, sf_dir):
    model = toxicity_model(spark, sf_dir)
    scored = table(spark, sf_dir, "documents").select("doc_id", held_out().alias("held_out"), toxicity.score_column(spark, model).alias("score"))
    return scored.select("*", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query
def op1_decontamination(spark, sf_dir):
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), min_words=1)


@query
def op2_mixing(spark, sf_dir):
    return mixing.allot(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


ORACLE["op2_mixing"] = f"""
WITH keyed AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
         xx, -ln((('0x' || substr(md5('{mixing.SEED}:' || coalesce(doc_id::VARCHAR, '')), 1, 12))::BIGINT + 0.5::DOUBLE) / {1 << 48}::DOUBLE)
           / (coalesce(length(regexp_replace(text, '[^\\p{{L}}\\p{{M}}]+', '', 'g')) / nullif(length(text), 0)::DOUBLE, 0) + 0.5) AS key
  FROM (SELECT *, md5(coalesce(text, '')) AS xx FROM documents)),
sizes AS (
  SELECT source, sum(size)::BIGINT AS source_size, [3, 1, 2][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS weight
  FROM keyed GROUP BY source),
levels AS (
  SELECT a.source, a.source_size, a.weight, 2.0::DOUBLE * a.source_size / a.weight AS full_at,
         (SELECT (1.5::DOUBLE * sum(source_size)::BIGINT - coalesce(sum(CASE WHEN b.source_size / b.weight < a.source_size / a.weight THEN 2 * source_size END), 0)::DOUBLE)
                 / sum(CASE WHEN b.source_size / b.weight >= a.source_size / a.weight THEN b.weight END) FROM sizes b) AS level
  FROM sizes a),
goal AS (
  SELECT source, source_size, least(2.0::DOUBLE * source_size, weight * (SELECT coalesce(arg_min(level, full_at), 1e300) FROM levels WHERE level < full_at)) AS target FROM levels),
cut AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size + 1e-12)::BIGINT ELSE 1 END AS epochs FROM goal),
run AS (
  SELECT keyed.*, source_size, target, epochs, greatest(0.0::DOUBLE, target - epochs * source_size) AS rest,
         sum(size) OVER (PARTITION BY keyed.source ORDER BY key, xx ROWS UNBOUNDED PRECEDING) - size AS ahead
  FROM keyed JOIN cut ON keyed.source IS NOT DISTINCT FROM cut.source)
SELECT doc_id, size, source_size, target, (size * (epochs + CASE WHEN rest > 0 AND ahead + size / 2.0::DOUBLE <= rest THEN 1 ELSE 0 END))::BIGINT AS taken FROM run
"""


SHARD_BYTES = 256 << 10


@query
def op4_sharding(spark, sf_dir):
    """Shards of at most 256 KiB, so that buckets split in tables of any size."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return sharding.shard(docs, SHARD_BYTES).drop("text")


@query
def op5_token_counts(spark, sf_dir):
    return token_counts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query
def op6_weighted_fingerprints(spark, sf_dir):
    return weighted_prints.edit_prints(table(spark, sf_dir, "documents"))


RULES = (("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block"))


@query
def op8_url_filter(spark, sf_dir):
    """The rules, and a list of the pages' own: URLs whose canonical form was fetched more than once are blocked."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    again = pages.groupBy(url_filter.canonical(F.col("url")).alias("form")).agg(F.count(F.lit(1)).alias("n"), F.min("url").alias("url")).filter("n > 1").select("url")
    rules = spark.sql(f"SELECT * FROM VALUES {', '.join(map(str, RULES))} AS t(rule, verdict)")
    return url_filter.judge(pages, rules, again).drop("url")


_RULES = ", ".join(f"('{r}', '{r.split('/')[0]}', '{r[len(r.split('/')[0]):]}', '{v}')" for r, v in RULES)
ORACLE["op8_url_filter"] = f"""
WITH cut AS (
  SELECT page_id, url, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (
  SELECT page_id, url, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
forms AS (SELECT *, regexp_replace(host, '^www\\.', '') || rtrim(path, '/') AS form FROM parts),
again AS (SELECT form FROM forms GROUP BY form HAVING count(*) > 1 AND form <> ''),
rules(rule, rule_host, rule_path, verdict) AS (VALUES {_RULES}),
fits AS (
  SELECT page_id, url, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict
  FROM forms JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path) GROUP BY page_id, url)
SELECT forms.page_id, host, path, rule,
       coalesce(verdict, CASE WHEN form IN (SELECT form FROM again) THEN 'block' ELSE 'allow' END) AS verdict
FROM forms LEFT JOIN fits ON forms.page_id = fits.page_id AND forms.url = fits.url
"""


@query
def op9_token_files(spark, sf_dir):
    return token_files.token_files(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query
def op3_line_dedup(spark, sf_dir):
    cleaned = line_dedup.line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return cleaned.select("doc_id", "n_lines", "n_deleted", F.sha2(F.encode("clean_text", "UTF-8"), 256).alias("clean_sha256"))


@query
def op12_fill_in_middle(spark, sf_dir):
    made = fill_middle.fill_in_middle(table(spark, sf_dir, "documents").select("doc_id", "text"), texts=False)
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256")


ORACLE["op12_fill_in_middle"] = r"""
WITH units AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS units,
         sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
drawn AS (
  SELECT *, len(units) AS n, ('0x' || substr(h, 1, 8))::BIGINT % (len(units) + 1) AS u1, ('0x' || substr(h, 9, 8))::BIGINT % (len(units) + 1) AS u2,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR ('0x' || substr(h, 17, 8))::BIGINT % 100 >= 50 THEN 'plain'
              WHEN ('0x' || substr(h, 25, 8))::BIGINT % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM units),
parts AS (
  SELECT *, array_to_string(units[1:least(u1, u2)], '') AS prefix, array_to_string(units[least(u1, u2) + 1:greatest(u1, u2)], '') AS middle,
         array_to_string(units[greatest(u1, u2) + 1:], '') AS suffix FROM drawn)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                        ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256, sha256(text) AS restored_sha256
FROM parts
"""


@query
def op13_vector_clusters(spark, sf_dir):
    return vector_clusters.clusters(table(spark, sf_dir, "embeddings"))


def _lloyd_sql(rounds: int) -> str:
    """All rounds one after another, a step for each; sums and distances over (vector, component) rows."""
    step = """
near{k} AS MATERIALIZED (
  SELECT row, arg_min(cluster, (distance, cluster)) AS cluster, min(distance) AS distance FROM (
    SELECT x.row, c.cluster, sum((x.x - c.x) * (x.x - c.x)) AS distance FROM x JOIN c{k} c USING (dim) GROUP BY ALL) GROUP BY row)"""
    move = """,
c{n} AS MATERIALIZED (
  SELECT c.cluster, c.dim, CASE WHEN n IS NULL THEN c.x ELSE (s - ((s % n) + n) % n) // n END AS x
  FROM c{k} c LEFT JOIN (SELECT cluster, dim, sum(x.x) AS s, count(*) AS n FROM x JOIN near{k} USING (row) GROUP BY ALL) USING (cluster, dim))"""
    steps = "".join("," + step.format(k=k) + (move.format(k=k, n=k + 1) if k < rounds else "") for k in range(rounds + 1))
    return f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER () AS row, vec_id, embedding FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda v: v IS NOT NULL AND isfinite(v))) = 64),
x AS MATERIALIZED (SELECT row, i AS dim, floor(1024 * embedding[i]::DOUBLE)::HUGEINT AS x FROM kept, unnest(range(1, 65)) AS t(i)),
first AS MATERIALIZED (
  SELECT row, row_number() OVER (ORDER BY sha256('3:' || coalesce(vec_id::VARCHAR, '')), embedding) - 1 AS cluster FROM kept
  QUALIFY cluster < 8),
c0 AS MATERIALIZED (SELECT cluster, dim, x.x FROM first JOIN x USING (row)){steps}
SELECT vec_id, cluster::INT AS cluster, distance::BIGINT AS distance, (sum(distance) OVER (PARTITION BY cluster))::BIGINT AS cluster_inertia,
       (sum(distance) OVER ())::BIGINT AS inertia, centroid_sha256
FROM kept JOIN near{rounds} USING (row) JOIN (SELECT cluster, sha256(string_agg(x::VARCHAR, ',' ORDER BY dim)) AS centroid_sha256 FROM c{rounds} GROUP BY cluster) USING (cluster)
"""


ORACLE["op13_vector_clusters"] = _lloyd_sql(vector_clusters.ROUNDS)


@query
def op11_suffix_dedup(spark, sf_dir):
    made = suffix_dedup.without_repeats(table(spark, sf_dir, "documents"))
    return made.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
