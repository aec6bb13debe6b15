"""Registered queries of this subpackage: each applies one operator with its production parameters to whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.llm.bpe import encode_decode
from fleetlens.llm.decontaminate import find_leaks
from fleetlens.llm.line_dedup import dedup_lines
from fleetlens.llm.merkle import manifest, proof
from fleetlens.llm.ngram_join import ngram_join
from fleetlens.llm.pii import find_pii
from fleetlens.llm.quality_qda import classify
from fleetlens.llm.quality_rules import quality_rules
from fleetlens.llm.simhash import hex_code, simhash_groups
from fleetlens.llm.spelling import variants
from fleetlens.llm.suffix_dedup import remove_repeats
from fleetlens.llm.token_count import count_tokens
from fleetlens.llm.url_filter import filter_urls

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), TOKENIZER).withColumn("over_limit", F.col("n_tokens") > 1024)


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = remove_repeats(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op3_quality_qda(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.withColumn("predicted", F.when(F.col("score") >= 0.3, 1).otherwise(0))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_decode(table(spark, sf_dir, "documents"), TOKENIZER, digests=True)


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join(table(spark, sf_dir, "documents")).drop("text_hash")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    trusted = table(spark, sf_dir, "labels").filter("quality = 1").select("doc_id")
    return quality_rules(table(spark, sf_dir, "documents"), trusted).drop("text_hash")


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_pii(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base_spans", 256).alias("base_sha256"), "spans")


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = manifest(table(spark, sf_dir, "documents")).withColumn("proof_sha256", F.sha2(proof(F.col("ups")), 256))
    return rows.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(table(spark, sf_dir, "documents")).select("word", "form", "root", "n", "n_near", "form_n")


def op13_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = simhash_groups(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", hex_code(F.col("code")).alias("fingerprint"), "component_id")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_counts": op1_token_counts,
    "op2_suffix_dedup": op2_suffix_dedup,
    "op3_quality_qda": op3_quality_qda,
    "op4_line_dedup": op4_line_dedup,
    "op5_decontaminate": op5_decontaminate,
    "op6_bpe": op6_bpe,
    "op7_ngram_join": op7_ngram_join,
    "op8_quality_rules": op8_quality_rules,
    "op9_pii": op9_pii,
    "op10_url_filter": op10_url_filter,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_simhash": op13_simhash,
}

OP4_SQL = r"""
WITH lines AS (
  SELECT doc_id, generate_subscripts(parts, 1) AS pos, unnest(parts) AS line
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents)),
keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
hot AS (
  SELECT key, max(doc_id) AS last_doc FROM keyed WHERE length(key) >= 20
  GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
judged AS (
  SELECT doc_id, pos, line, coalesce(doc_id < last_doc, false) AS gone FROM keyed LEFT JOIN hot USING (key))
SELECT doc_id, count(*) AS n_lines, CAST(coalesce(sum(CASE WHEN gone THEN 1 END), 0) AS BIGINT) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""

OP11_SQL = """
WITH RECURSIVE given AS (
  SELECT doc_id, source, text, concat_ws('', coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-'), coalesce(strlen(source) || ':' || source, '-'),
    coalesce(strlen(lang) || ':' || lang, '-'), coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-')) AS head,
    xor(list_reduce(list_concat([4294967295::UBIGINT], flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: [ord(c)::UBIGINT, 0, 0, 0, 0, 0, 0, 0]))),
      lambda a, e: CASE WHEN xor(a, e) % 2 = 1 THEN xor(xor(a, e) // 2, 3988292384::UBIGINT) ELSE xor(a, e) // 2 END), 4294967295::UBIGINT) AS crc
  FROM documents),
leaves AS (
  SELECT doc_id, source, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
    CASE WHEN crc % 5 = 0 THEN sha256(head || coalesce(strlen(text) || ':' || translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '-')) END AS forged
  FROM given),
placed AS (
  SELECT *, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos,
    count(*) OVER (PARTITION BY source) AS n FROM leaves),
nodes AS (
  SELECT tree, 0 AS level, pos, leaf AS digest, n FROM placed
  UNION ALL
  SELECT tree, level + 1, pos // 16, sha256(string_agg(digest, '' ORDER BY pos)), (any_value(n) + 15) // 16 FROM nodes WHERE n > 1 GROUP BY tree, level, pos // 16),
subroots AS (SELECT tree, digest AS subroot FROM nodes WHERE n = 1),
tops AS (
  SELECT 0 AS level, tree AS pos, subroot AS digest, (SELECT count(*) FROM subroots) AS n FROM subroots
  UNION ALL
  SELECT level + 1, pos // 16, sha256(string_agg(digest, '' ORDER BY pos)), (any_value(n) + 15) // 16 FROM tops WHERE n > 1 GROUP BY level, pos // 16),
roots AS (SELECT digest AS root FROM tops WHERE n = 1),
inner_steps AS (
  SELECT p.tree, p.pos, l.level, coalesce(string_agg(k.digest, '' ORDER BY k.pos) FILTER (k.pos < p.pos // CAST(16 ** l.level AS BIGINT)), '') AS before,
    coalesce(string_agg(k.digest, '' ORDER BY k.pos) FILTER (k.pos > p.pos // CAST(16 ** l.level AS BIGINT)), '') AS after
  FROM placed p JOIN (SELECT DISTINCT tree, level FROM nodes WHERE n > 1) l ON l.tree = p.tree
  JOIN nodes k ON k.tree = p.tree AND k.level = l.level AND k.pos // 16 = p.pos // CAST(16 ** (l.level + 1) AS BIGINT) GROUP BY ALL),
outer_steps AS (
  SELECT s.tree, 100 + l.level AS level, coalesce(string_agg(k.digest, '' ORDER BY k.pos) FILTER (k.pos < s.tree // CAST(16 ** l.level AS BIGINT)), '') AS before,
    coalesce(string_agg(k.digest, '' ORDER BY k.pos) FILTER (k.pos > s.tree // CAST(16 ** l.level AS BIGINT)), '') AS after
  FROM subroots s CROSS JOIN (SELECT DISTINCT level FROM tops WHERE n > 1) l
  JOIN tops k ON k.level = l.level AND k.pos // 16 = s.tree // CAST(16 ** (l.level + 1) AS BIGINT) GROUP BY s.tree, l.level),
steps AS (
  SELECT tree, pos, list(before || '|' || after ORDER BY level) AS ups, string_agg(before || after, '' ORDER BY level) AS proof
  FROM (SELECT * FROM inner_steps UNION ALL SELECT o.tree, p.pos, o.level, o.before, o.after FROM outer_steps o JOIN placed p USING (tree)) x GROUP BY 1, 2),
folded AS (
  SELECT p.*, coalesce(s.proof, '') AS proof, list_reduce(list_concat([coalesce(forged, leaf)], coalesce(s.ups, [])),
    lambda v, u: sha256(split_part(u, '|', 1) || v || split_part(u, '|', 2))) AS folded_root
  FROM placed p LEFT JOIN steps s USING (tree, pos))
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, folded_root, folded_root = root AS verified
FROM folded JOIN subroots USING (tree) CROSS JOIN roots
"""

OP12_SQL = """
WITH RECURSIVE runs AS (
  SELECT doc_id, run, count(*) AS k FROM (
    SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\u00C0-\u00FF]+')) AS run FROM documents) r
  WHERE length(run) >= 5 GROUP BY 1, 2),
summed AS (
  SELECT run, k, xor(list_reduce(list_concat([4294967295::UBIGINT], flatten(list_transform(range(0, length(code), 2), lambda i: [
      CAST('0x' || substring(code, i + 1, 2) AS UBIGINT), 0, 0, 0, 0, 0, 0, 0]))),
    lambda a, e: CASE WHEN xor(a, e) % 2 = 1 THEN xor(xor(a, e) // 2, 3988292384::UBIGINT) ELSE xor(a, e) // 2 END), 4294967295::UBIGINT) AS h
  FROM (SELECT run, k, hex(encode(doc_id || ':' || run)) AS code FROM runs) x),
words AS (
  SELECT word, CAST(sum(k) AS BIGINT) AS n FROM (
    SELECT k, CASE WHEN h % 97 = 0 THEN substring(run, 1, CAST(h % length(run) AS BIGINT)) || substring(run, CAST(h % length(run) AS BIGINT) + 2) ELSE run END AS word FROM summed) x
  WHERE length(word) >= 5 GROUP BY 1 HAVING sum(k) >= 3),
cuts AS (SELECT word, n, i, substring(word, 1, i) || substring(word, i + 2) AS rest FROM (SELECT word, n, unnest(range(0, length(word))) AS i FROM words) x),
pairs AS (
  SELECT DISTINCT a.word, b.word AS near, b.n FROM cuts a JOIN cuts b ON b.rest = a.rest AND b.i = a.i AND b.word <> a.word
  UNION SELECT DISTINCT a.word, b.word, b.n FROM cuts a JOIN words b ON b.word = a.rest
  UNION SELECT DISTINCT b.word, a.word, a.n FROM cuts a JOIN words b ON b.word = a.rest),
best AS (SELECT word, count(*) AS n_near, first(near ORDER BY n DESC, near) AS near, max(n) AS near_n FROM pairs GROUP BY 1),
forms AS (
  SELECT w.word, w.n, coalesce(b.n_near, 0) AS n_near, CASE WHEN b.near_n >= 2 * w.n THEN b.near END AS form, CASE WHEN b.near_n >= 2 * w.n THEN b.near_n END AS form_n
  FROM words w LEFT JOIN best b USING (word)),
chain AS (SELECT word, word AS root, form AS next FROM forms UNION ALL SELECT c.word, f.word, f.form FROM chain c JOIN forms f ON f.word = c.next)
SELECT word, form, root, n, n_near, form_n FROM forms JOIN (SELECT word, root FROM chain WHERE next IS NULL) c USING (word)
"""

OP7_SQL = r"""
WITH RECURSIVE split AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t\n\x0B\f\r]+'), lambda w: w <> '') AS words
  FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 3 THEN [array_to_string(words, ' ')]
    ELSE list_distinct(list_transform(range(1, len(words) - 1), lambda i: words[i] || ' ' || words[i + 1] || ' ' || words[i + 2])) END AS shingles FROM split),
each AS (SELECT doc_id, len(shingles) AS n, unnest(shingles) AS shingle FROM sets),
links AS (
  SELECT a.doc_id AS x, b.doc_id AS y FROM each a JOIN each b ON b.shingle = a.shingle AND b.doc_id <> a.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))),
reached AS (SELECT doc_id, doc_id AS node FROM sets UNION SELECT r.doc_id, l.y FROM reached r JOIN links l ON l.x = r.node)
SELECT doc_id, CAST(len(shingles) AS BIGINT) AS n_shingles, component_id FROM sets JOIN (SELECT doc_id, min(node) AS component_id FROM reached GROUP BY 1) c USING (doc_id)
"""

ORACLE: dict[str, str] = {"op4_line_dedup": OP4_SQL, "op7_ngram_join": OP7_SQL, "op11_merkle_manifest": OP11_SQL, "op12_spelling_variants": OP12_SQL}
