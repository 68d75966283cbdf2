"""Registered queries of this subpackage with their SQL checks."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from telemill.llm.common import ORACLES, QUERIES, table
from telemill.llm.line_dedup import remove_repeats
from telemill.llm.minhash import near_duplicates
from telemill.llm.ngram_lm import score_documents
from telemill.llm.packing import pack_documents
from telemill.llm import decontaminate, itq, merkle, mixing, toxicity
from telemill.llm.surrogates import pseudonymise
from telemill.llm.token_counts import section_tokens
from telemill.llm.warc import archive_roundtrip
from telemill.llm.whitening import whiten
from telemill.session import fresh_path, prepare

__all__ = ["ORACLES", "QUERIES"]

KEY = b"telemill test key"  # production jobs pass their own


def query(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = lambda spark, sf: fn(prepare(spark), sf)
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return deco


@query("op2_packing")
def op2(spark: SparkSession, sf: str) -> DataFrame:
    """No SQL: DuckDB has no tokenizer. Checked by decoding every sequence in tests/llm."""
    return pack_documents(table(spark, sf, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query("op3_minhash_near_dedup")
def op3(spark: SparkSession, sf: str) -> DataFrame:
    """No SQL: linking all pairs of whole texts is too slow there. Checked against brute force in tests/llm."""
    return near_duplicates(table(spark, sf, "documents"), size=2, threshold=0.8)


def fold(n: int):
    """crc32 of the id as text, modulo n."""
    return F.crc32(F.col("doc_id").cast("string")) % n


@query("op5_ngram_trie_scores")
def op5(spark: SparkSession, sf: str) -> DataFrame:
    """No SQL: quantised trie probabilities. Base scores and counts are checked against brute force in tests/llm."""
    docs = table(spark, sf, "documents")
    scored = score_documents(docs, fold(5) != 1)
    return scored.select("doc_id", (fold(5) == 1).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


@query("op7_warc_boundary_chain")
def op7(spark: SparkSession, sf: str) -> DataFrame:
    """No SQL: DuckDB's digests have no base32. Checked against hashlib in tests/llm."""
    return archive_roundtrip(table(spark, sf, "pages"), fresh_path(spark))


@query("op8_toxicity_trees")
def op8(spark: SparkSession, sf: str) -> DataFrame:
    """No SQL: a fitted model. Held-out accuracy is tested in tests/llm."""
    scored = toxicity.score_documents(table(spark, sf, "documents"), table(spark, sf, "labels"), fold(4) != 2, fold(4) == 3)
    return scored.select("doc_id", (fold(4) == 2).alias("held_out"), "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"))


@query("op9_itq_hamming_near_dedup")
def op9(spark: SparkSession, sf: str) -> DataFrame:
    """No SQL: all pairs of whole tables are too many there. Checked against brute force in tests/llm."""
    return itq.near_duplicates(table(spark, sf, "embeddings"))


# word shingles of lower-cased (A-Z only) texts; DuckDB's lower() would change more, so letters are mapped
_AZ = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
_SHINGLED = """
SELECT DISTINCT {id}, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
       ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s
FROM (SELECT {id}, list_filter(regexp_split_to_array(translate(text, {az}), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM {table} WHERE {id} IS NOT NULL AND text IS NOT NULL)
"""


@query("op10_minhash_containment", f"""
WITH i AS ({_SHINGLED.format(id='item_id', table='benchmark', az=_AZ)}),
d AS ({_SHINGLED.format(id='doc_id', table='documents', az=_AZ)}),
n AS (SELECT item_id, count(*) AS n_shingles FROM i GROUP BY item_id)
SELECT doc_id, item_id, n_shingles, count(*) AS n_shared
FROM i JOIN d USING (s) JOIN n USING (item_id) GROUP BY doc_id, item_id, n_shingles HAVING 100 * count(*) >= 80 * n_shingles
""")
def op10(spark: SparkSession, sf: str) -> DataFrame:
    return decontaminate.contained_items(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


@query("op1_line_chunk_dedup")
def op1(spark: SparkSession, sf: str) -> DataFrame:
    """No SQL: content-defined boundaries. Checked against a brute-force version in tests/llm."""
    return remove_repeats(table(spark, sf, "documents")).select("doc_id", "text", "n_lines", "n_removed")


@query("op4_pii_surrogates")
def op4(spark: SparkSession, sf: str) -> DataFrame:
    """No SQL: keyed surrogates. Detection, formats and distinctness are tested in tests/llm."""
    return pseudonymise(table(spark, sf, "documents"), KEY).select("doc_id", "text", "n_entities", "kinds")


@query("op6_token_attribution")
def op6(spark: SparkSession, sf: str) -> DataFrame:
    """No SQL: DuckDB has no tokenizer. Checked against another library's offsets in tests/llm."""
    return section_tokens(table(spark, sf, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


_COUNTED = r"[^\x20\x09-\x0D]+"


@query("op11_water_filling_mix", f"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '{_COUNTED}')), 0)::BIGINT AS size,
         left(md5(concat_ws(':', '0', coalesce(doc_id::VARCHAR, '-'), coalesce(md5(text), '-'))), 15) AS place FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, 1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS weight FROM d GROUP BY source),
-- sources that reach their cap come first in the order of cap over weight
o AS (SELECT *, sum(source_size) OVER () AS total, sum(weight) OVER () AS weights,
             coalesce(sum(3 * source_size) OVER p, 0) AS caps_before, coalesce(sum(weight) OVER p, 0) AS weights_before
      FROM s WINDOW p AS (ORDER BY 3.0 * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
c AS (SELECT *, 3 * source_size * (weights - weights_before) < weight * (total - caps_before) AS capped FROM o),
t AS (SELECT source, source_size, CASE WHEN capped THEN 3.0 * source_size ELSE
             (total - coalesce(sum(3 * source_size) FILTER (WHERE capped) OVER (), 0))::DOUBLE * weight / (sum(weight) FILTER (WHERE NOT capped) OVER ()) END::DOUBLE AS target FROM c),
w AS (SELECT *, round(target)::BIGINT AS words, CASE WHEN source_size = 0 THEN 0 ELSE round(target)::BIGINT // source_size END AS whole FROM t),
r AS (SELECT d.doc_id, d.size, w.source_size, w.target, w.whole, w.words - w.whole * w.source_size AS rest,
             coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
      FROM d JOIN w ON d.source IS NOT DISTINCT FROM w.source)
SELECT doc_id, size, source_size, target, (whole * size + greatest(0, least(size, rest - before)))::BIGINT AS taken FROM r
""")
def op11(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    planned = mixing.plan_mix(docs, mixing.cyclic_weights(docs, [1, 2, 3]), max_epochs=3, carry=("doc_id",))
    return planned.select("doc_id", "size", "source_size", "target", (F.col("whole") * F.col("size") + F.col("part")).alias("taken"))


def _h(text: str) -> str:
    return f"concat({', '.join(f"""coalesce(strlen({c}::VARCHAR)::VARCHAR || ':' || {c}::VARCHAR, '-')""" for c in ('doc_id', 'source', 'lang', 'n_chars', text))})"


def _tree(name: str, base: str) -> str:
    """Levels of 3-ary trees over ``g, pos, n, d``."""
    return f"""{name} AS (SELECT g, 0 AS lvl, pos, n, d FROM {base} UNION ALL
  SELECT g, lvl + 1, pos // 3, (n + 2) // 3, sha256(string_agg(d, '' ORDER BY pos)) FROM {name} WHERE n > 1 GROUP BY g, lvl, n, pos // 3)"""


@query("op12_merkle_manifest", f"""
WITH RECURSIVE crc AS (  -- of the decimal id, bit by bit
  SELECT doc_id, list_reduce(list_concat([4294967295], flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: [ord(c), 0, 0, 0, 0, 0, 0, 0]))),
    lambda a, b: xor(xor(a, b) >> 1, 3988292384 * (xor(a, b) & 1))) AS c FROM documents WHERE doc_id IS NOT NULL),
leaf AS (SELECT d.doc_id, d.source AS g, sha256({_h('text')}) AS d,
    CASE WHEN xor(c.c, 4294967295) % 2 = 0 THEN sha256({_h("replace(text, chr(10), '')")}) ELSE sha256({_h('text')}) END AS other
  FROM documents d LEFT JOIN crc c USING (doc_id)),
base AS (SELECT coalesce('=' || g, '') AS g, (row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, d) - 1) AS pos, count(*) OVER (PARTITION BY g) AS n, d, doc_id, other FROM leaf),
{_tree('low', 'base')},
subs AS (SELECT g AS of, (row_number() OVER (ORDER BY g) - 1) AS pos, count(*) OVER () AS n, d, '' AS g FROM low WHERE n = 1),
{_tree('high', 'subs')},
sib AS (
  SELECT b.doc_id, b.d AS leaf, b.g, b.pos AS i, t.lvl, t.pos - (b.pos // (3 ** t.lvl)::BIGINT) AS side, t.d
    FROM base b JOIN low t ON t.g = b.g AND t.n > 1 AND t.pos // 3 = b.pos // (3 ** (t.lvl + 1))::BIGINT AND t.pos <> b.pos // (3 ** t.lvl)::BIGINT
  UNION ALL
  SELECT b.doc_id, b.d, b.g, b.pos, 100 + t.lvl, t.pos - (s.pos // (3 ** t.lvl)::BIGINT), t.d
    FROM base b JOIN subs s ON s.of = b.g JOIN high t ON t.n > 1 AND t.pos // 3 = s.pos // (3 ** (t.lvl + 1))::BIGINT AND t.pos <> s.pos // (3 ** t.lvl)::BIGINT),
-- one step per level: also those of a run with one node
steps AS (
  SELECT b.g, b.pos AS i, row_number() OVER (PARTITION BY b.g, b.pos ORDER BY l.lvl) AS k, l.lvl
  FROM base b JOIN (SELECT DISTINCT g, lvl FROM low WHERE n > 1 UNION ALL SELECT DISTINCT s.of, 100 + h.lvl FROM subs s, (SELECT DISTINCT lvl FROM high WHERE n > 1) h) l ON l.g = b.g),
sides AS (SELECT s.g, s.i, s.k, coalesce(string_agg(x.d, '' ORDER BY x.side) FILTER (WHERE x.side < 0), '') AS l, coalesce(string_agg(x.d, '' ORDER BY x.side) FILTER (WHERE x.side > 0), '') AS r
  FROM steps s LEFT JOIN sib x ON x.g = s.g AND x.i = s.i AND x.lvl = s.lvl GROUP BY s.g, s.i, s.k),
fold AS (SELECT g, pos AS i, 0::BIGINT AS k, other AS x FROM base UNION ALL
  SELECT f.g, f.i, s.k, sha256(s.l || f.x || s.r) FROM fold f JOIN sides s ON s.g = f.g AND s.i = f.i AND s.k = f.k + 1),
folded AS (SELECT g, i, max_by(x, k) AS folded_root FROM fold GROUP BY g, i),
proof AS (SELECT g, i, sha256(string_agg(l || r, '' ORDER BY k)) AS proof_sha256 FROM sides GROUP BY g, i),
root AS (SELECT d AS root FROM high WHERE n = 1)
SELECT b.doc_id, b.d AS leaf, s.d AS subroot, root.root, coalesce(p.proof_sha256, sha256('')) AS proof_sha256, f.folded_root, f.folded_root = root.root AS verified
FROM base b JOIN subs s ON s.of = b.g JOIN folded f ON f.g = b.g AND f.i = b.pos LEFT JOIN proof p ON p.g = b.g AND p.i = b.pos CROSS JOIN root
""")
def op12(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    tampered = F.when(fold(2) == 0, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    rows = merkle.leaves(docs, ["doc_id", "source", "lang", "n_chars", "text"], "doc_id", "source", {"text": tampered})
    return merkle.proofs(rows).withColumnRenamed("id", "doc_id")


@query("op13_whitening")
def op13(spark: SparkSession, sf: str) -> DataFrame:
    """No SQL: an eigenproblem. Checked against a dense eigendecomposition in tests/llm."""
    return whiten(table(spark, sf, "embeddings"), components=8)
