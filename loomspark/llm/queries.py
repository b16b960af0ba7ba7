"""Queries of the training-data operators for the driver's registry: each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import bpe, jaccard, langid, media, packing, pii, quotes, secrets, topk, toxicity
from ._common import table


def op1_quotation_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotes.thread(table(spark, sf_dir, "conversations"))


def op2_iso_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.containers(table(spark, sf_dir, "documents"))


def op3_pair_index_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op4_boosted_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(table(spark, sf_dir, "documents"))


def op5_factorization_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.predictions(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_forest_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"))


def op7_compression_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op8_branch_and_bound_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(table(spark, sf_dir, "embeddings"), "vec_id % 50 = 0")


def op9_parity_sketch_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.classes(table(spark, sf_dir, "documents"), words=3, num=90, den=100)


def op10_karmarkar_karp_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_quotation_links, op2_iso_media, op3_pair_index_bpe, op4_boosted_pii, op5_factorization_toxicity, op6_forest_secrets, op7_compression_language, op8_branch_and_bound_topk, op9_parity_sketch_join, op10_karmarkar_karp_packing)}

ORACLE_SQL: dict[str, str] = {
    # line levels, passages, first writers and reply chains; hashes are left out, as equal texts have equal hashes
    "op1_quotation_links": r"""
WITH RECURSIVE m AS (SELECT row_number() OVER () AS id, conv_id, turn, role, string_split(replace(replace(coalesce(text, ''), chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10)) AS lines FROM conversations),
l AS (SELECT id, conv_id, turn, i, length(regexp_replace(regexp_extract(x, '^(?:[ \t]{0,3}>)+[ \t]?'), '[^>]', '', 'g')) AS level, regexp_replace(x, '^(?:[ \t]{0,3}>)+[ \t]?', '') AS body
  FROM (SELECT id, conv_id, turn, unnest(lines) AS x, generate_subscripts(lines, 1) AS i FROM m)),
r AS (SELECT *, sum(new) OVER (PARTITION BY id ORDER BY i) AS run FROM (SELECT *, CASE WHEN lag(level) OVER (PARTITION BY id ORDER BY i) IS DISTINCT FROM level THEN 1 ELSE 0 END AS new FROM l)),
p AS (SELECT id, conv_id, turn, run, any_value(level) AS level, string_agg(body, ' ' ORDER BY i) AS flat, string_agg(body, chr(10) ORDER BY i) AS body FROM r GROUP BY id, conv_id, turn, run),
o AS (SELECT id, regexp_replace(coalesce(string_agg(body, chr(10) ORDER BY run) FILTER (WHERE level = 0), ''), '^\s+|\s+$', '', 'g') AS own FROM p GROUP BY id),
u AS (SELECT conv_id, turn, flat AS x FROM p WHERE level = 0 UNION ALL SELECT conv_id, turn, body FROM r WHERE level = 0 UNION ALL SELECT conv_id, turn, own FROM o JOIN m USING (id)),
f AS (SELECT conv_id, trim(regexp_replace(lower(x), '[^\p{L}\p{N}]+', ' ', 'g')) AS x, min(turn) AS original FROM u GROUP BY 1, 2),
q AS (SELECT DISTINCT conv_id, turn, run, level, flat, body FROM p WHERE level > 0),
w AS (SELECT q.*, f.original FROM q LEFT JOIN f ON f.conv_id = q.conv_id AND f.x <> '' AND f.original < q.turn AND f.x = trim(regexp_replace(lower(q.flat), '[^\p{L}\p{N}]+', ' ', 'g'))),
s AS (SELECT w.*, coalesce(w.original, (SELECT max(f.original) FROM (SELECT unnest(string_split(w.body, chr(10))) AS b) JOIN f ON f.conv_id = w.conv_id AND f.x <> '' AND f.original < w.turn AND f.x = trim(regexp_replace(lower(b), '[^\p{L}\p{N}]+', ' ', 'g')))) AS source FROM w),
k AS (SELECT conv_id, turn, count(*) AS n_quotes, count(source) AS n_linked, arg_max(source, (-level, source)) AS parent_turn FROM s GROUP BY 1, 2),
t(conv_id, turn, up, steps) AS (SELECT conv_id, turn, parent_turn, 1 FROM k WHERE parent_turn IS NOT NULL UNION ALL SELECT t.conv_id, t.turn, k.parent_turn, steps + 1 FROM t JOIN k ON k.conv_id = t.conv_id AND k.turn = t.up WHERE k.parent_turn IS NOT NULL),
e AS (SELECT conv_id, turn, arg_max(up, steps) AS thread_root, max(steps) AS reply_depth FROM t GROUP BY 1, 2),
d AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY coalesce(thread_root, turn), turn) - 1 AS place FROM (SELECT DISTINCT conv_id, turn FROM conversations) LEFT JOIN e USING (conv_id, turn))
SELECT m.conv_id, m.turn, m.role, k.parent_turn, coalesce(e.thread_root, m.turn) AS thread_root, CAST(coalesce(e.reply_depth, 0) AS BIGINT) AS reply_depth, d.place, coalesce(k.n_quotes, 0) AS n_quotes, coalesce(k.n_linked, 0) AS n_linked, o.own AS own_text
FROM m JOIN o USING (id) LEFT JOIN k ON k.conv_id = m.conv_id AND k.turn = m.turn LEFT JOIN e ON e.conv_id = m.conv_id AND e.turn = m.turn LEFT JOIN d ON d.conv_id = m.conv_id AND d.turn = m.turn""",
    "op8_branch_and_bound_topk": """
WITH v AS (SELECT vec_id, [CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE) for x in embedding] AS z FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) > 0 AND NOT list_contains([x IS NULL OR NOT isfinite(x) for x in embedding], true))
SELECT query_id, CAST(rank AS INT) AS rank, vec_id, score FROM (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.z, c.z) AS BIGINT) AS score, row_number() OVER (PARTITION BY q.vec_id ORDER BY list_dot_product(q.z, c.z) DESC, c.vec_id) AS rank
FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0) WHERE rank <= 5""",
    # sets as lists of shingles, all pairs with a common shingle, then least labels along links
    "op9_parity_sketch_join": r"""
WITH RECURSIVE w AS (SELECT doc_id, [y for y in regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+') if y <> ''] AS x FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(x) < 3 THEN array_to_string(x, ' ') ELSE x[i] || ' ' || x[i + 1] || ' ' || x[i + 2] END AS g FROM (SELECT doc_id, x, unnest(range(1, greatest(2, len(x) - 1))) AS i FROM w WHERE len(x) > 0)),
n AS (SELECT doc_id, count(*) AS c FROM s GROUP BY 1),
l AS MATERIALIZED (SELECT a, b FROM (SELECT p.doc_id AS a, q.doc_id AS b, count(*) AS common FROM s p JOIN s q ON p.g = q.g AND p.doc_id <> q.doc_id GROUP BY 1, 2) JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= 90 * (x.c + y.c - common)),
t(a, b) AS (SELECT a, b FROM l UNION SELECT t.a, l.b FROM t JOIN l ON l.a = t.b)
SELECT w.doc_id, coalesce(n.c, 0) AS n_shingles, least(w.doc_id, coalesce(m.b, w.doc_id)) AS component_id FROM w LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT a AS doc_id, min(b) AS b FROM t GROUP BY 1) m USING (doc_id)""",
}
