"""The queries ``opN_<name>``: each applies one operator, with production parameters, to a whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, language_id, license_scan, line_dedup, lsh_ann, mixing, pitman_yor, prefix_trie, quality_gam, simhash, suffix_dedup, token_align, vector_graph
from .common import read_table


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


OP1_SQL = r"""
WITH lines AS (
  SELECT doc_id, t.line, t.pos,
         translate(trim(t.line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, unnest(list_zip(l, range(1, len(l) + 1))) AS z
        FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)) s,
       LATERAL (SELECT z[1] AS line, z[2] AS pos) t
), shared AS (
  SELECT k, max(doc_id) AS keeper FROM lines WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3
), marked AS (
  SELECT l.doc_id, l.line, l.pos, s.k IS NOT NULL AND s.keeper <> l.doc_id AS gone
  FROM lines l LEFT JOIN shared s ON l.k = s.k
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.simhash_components(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op3_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pitman_yor.score_documents(read_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op4_quality_gam(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality_gam.score_quality(docs, read_table(spark, sf_dir, "labels").select("doc_id", "quality"))


def op5_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(read_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.bpe_round_trip(read_table(spark, sf_dir, "documents").select("doc_id", "text"), bpe.vocabulary_path())


def op7_lsh_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return lsh_ann.nearest(vectors, F.col("vec_id") % 20 == 0)


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sizes(read_table(spark, sf_dir, "documents").select("doc_id", "text", "source"))


def op9_vector_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_graph.link_vectors(read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))


OP9_SQL = """
WITH RECURSIVE good AS (
  SELECT DISTINCT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings
), pairs AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b
  ON a.label = b.label AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.v, b.v) >= 0.93
), reach(a, b) AS (
  SELECT vec_id, vec_id FROM good UNION SELECT r.a, p.b FROM reach r JOIN pairs p ON r.b = p.a
), comp AS (SELECT a, min(b) AS c FROM reach GROUP BY a),
links AS (SELECT a, count(*) AS n FROM pairs GROUP BY a)
SELECT g.vec_id, coalesce(l.n, 0) AS n_links, c.c AS component_id, g.vec_id = c.c AS kept
FROM good g JOIN comp c ON c.a = g.vec_id LEFT JOIN links l ON l.a = g.vec_id
"""


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return language_id.identify(docs).select("doc_id", "held_out", "lang_pred", "score", "n_langs")


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.conversation_trie(read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))


CRC32_SQL = """list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST({x} AS VARCHAR), ''), lambda d: ascii(d)::BIGINT)),
  lambda a, d: list_reduce(list_prepend(xor(a, d), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda e, z: xor(e >> 1, 3988292384 * (e & 1))))"""

OP11_SQL = f"""
WITH turns AS (
  SELECT conv_id AS conv, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS idx
  FROM conversations WHERE conv_id IS NOT NULL
), own AS (
  SELECT conv, idx, sha256(strlen(role) || ':' || role || text) AS tid, strlen(text) AS size FROM turns
), convs AS (
  SELECT conv, conv - conv % 5 AS base, xor({CRC32_SQL.format(x="conv")}, 4294967295) % 9 AS h FROM (SELECT DISTINCT conv FROM own)
), seqs AS (
  SELECT c.conv, 0 AS part, o.idx, o.tid, o.size FROM convs c JOIN own o ON o.conv = c.base AND o.idx < c.h
  UNION ALL SELECT c.conv, 1, o.idx, o.tid, o.size FROM convs c JOIN own o ON o.conv = c.conv AND o.idx >= c.h
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv ORDER BY part, idx) AS pos FROM seqs
), paths AS (
  SELECT conv, pos, size, sha256(string_agg(tid, ',') OVER (PARTITION BY conv ORDER BY pos)) AS node FROM placed
  UNION ALL SELECT conv, 0, 0, '' FROM convs
), steps AS (
  SELECT *, lag(node) OVER w AS up, lead(node) OVER w IS NULL AS ends FROM paths WINDOW w AS (PARTITION BY conv ORDER BY pos)
), nodes AS (
  SELECT node, pos, min(conv) AS conv_id, count(*) AS n_convs, any_value(up) AS up, any_value(size) AS size,
         sha256(coalesce(string_agg(CAST(conv AS VARCHAR), ',' ORDER BY conv) FILTER (WHERE ends), '')) AS ends_sha256
  FROM steps GROUP BY node, pos
), kids AS (SELECT up, count(*) AS n FROM nodes WHERE up IS NOT NULL GROUP BY up),
below AS (
  SELECT p.node, count(*) FILTER (WHERE k.n IS NULL) AS n_leaves, sum((u.n_convs - 1) * u.size) AS saved
  FROM nodes u LEFT JOIN kids k ON k.up = u.node JOIN paths p ON p.conv = u.conv_id AND p.pos <= u.pos GROUP BY p.node
)
SELECT n.conv_id, n.pos AS depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(k.n, 0) AS n_children, b.n_leaves,
       CAST(b.saved AS BIGINT) AS saved_tokens, n.ends_sha256
FROM nodes n JOIN below b ON b.node = n.node LEFT JOIN nodes p ON p.node = n.up LEFT JOIN kids k ON k.up = n.node
"""


def op12_token_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_align.token_links(read_table(spark, sf_dir, "documents").select("doc_id", "text"), *token_align.public_vocabularies())


def op13_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(read_table(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES = {f.__name__: f for f in (op1_line_dedup, op2_simhash, op3_pitman_yor, op4_quality_gam, op5_suffix_array, op6_bpe, op7_lsh_ann, op8_mixing, op9_vector_graph, op10_language_id, op11_prefix_trie, op12_token_align, op13_license_scan)}
ORACLE_SQL = {"op1_line_dedup": OP1_SQL, "op9_vector_graph": OP9_SQL, "op11_prefix_trie": OP11_SQL}
