"""The registered queries: thin digests of the operators over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from chronoweave.llm.conversations import repair_damaged
from chronoweave.llm.embedding_dedup import near_vectors
from chronoweave.llm.lattice_lm import score_texts
from chronoweave.llm.minhash import near_duplicates
from chronoweave.llm.packing import pack_documents
from chronoweave.llm.piece_codec import encode_pieces
from chronoweave.llm.quality import score_quality
from chronoweave.llm.repetitions import periodic_runs
from chronoweave.llm.simhash import compare_with_next, near_fingerprints
from chronoweave.llm.suffix_dedup import remove_repeats
from chronoweave.llm.token_counts import count_tokens
from chronoweave.llm.toxicity import score_toxicity
from chronoweave.llm.window_dedup import remove_repeated_windows


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(_documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_documents(spark, sf_dir), percent=85)


def op3_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(_documents(spark, sf_dir), length=200)


def op4_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_pieces(_documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"), with_texts=False)


def op5_lattice_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(_documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))


def op6_ordinal_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(_documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))


def op9_simhash_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_with_next(_documents(spark, sf_dir))


def fingerprint_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The block tables of op9's operator, which the contract of op9 doesn't ask for."""
    return near_fingerprints(_documents(spark, sf_dir), radius=16, together=2)


def op10_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), cosine=0.95)


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op12_window_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeated_windows(_documents(spark, sf_dir), size=13)


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs(_documents(spark, sf_dir), least=12, edited=True)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_best_fit_packing": op1_best_fit_packing,
    "op2_minhash_near_dedup": op2_minhash_near_dedup,
    "op3_suffix_array_dedup": op3_suffix_array_dedup,
    "op4_piece_codec": op4_piece_codec,
    "op5_lattice_lm": op5_lattice_lm,
    "op6_ordinal_toxicity": op6_ordinal_toxicity,
    "op7_quality_classifier": op7_quality_classifier,
    "op8_token_counts": op8_token_counts,
    "op9_simhash_fingerprints": op9_simhash_fingerprints,
    "op10_embedding_near_dedup": op10_embedding_near_dedup,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_window_dedup": op12_window_dedup,
    "op13_periodic_runs": op13_periodic_runs,
    "fingerprint_groups": fingerprint_groups,
}

#: Components of links (a, b), each listed once, over ids (id): a closing part of both queries' SQL.
_COMPONENTS = """
both_ AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reached(a, b) AS (SELECT a, b FROM both_ UNION SELECT r.a, e.b FROM reached r JOIN both_ e ON r.b = e.a),
lowest AS (SELECT a AS id, min(b) AS low FROM reached GROUP BY a)
"""

_OP2 = f"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents
),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM words
),
items AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets),
common AS (SELECT p.doc_id AS a, q.doc_id AS b, any_value(p.n) AS n, any_value(q.n) AS m, count(*) AS c FROM items p JOIN items q ON p.x = q.x AND p.doc_id < q.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM common WHERE 100 * c >= 85 * (n + m - c)),
{_COMPONENTS}
SELECT doc_id, len(s)::BIGINT AS n_shingles, least(doc_id, coalesce(low, doc_id)) AS component_id, doc_id <= coalesce(low, doc_id) AS kept
FROM sets LEFT JOIN lowest ON doc_id = id
"""

_OP10 = f"""
WITH RECURSIVE vectors AS (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings),
fine AS (
  SELECT vec_id, x, sqrt(list_dot_product(x, x)) AS norm FROM vectors
  WHERE x IS NOT NULL AND len(list_filter(x, lambda v: v IS NULL OR NOT isfinite(v))) = 0 AND len(list_filter(x, lambda v: v <> 0)) > 0
),
links AS (
  SELECT p.vec_id AS a, q.vec_id AS b FROM fine p JOIN fine q ON p.vec_id < q.vec_id AND len(p.x) = len(q.x) WHERE list_dot_product(p.x, q.x) >= 0.95 * p.norm * q.norm
),
{_COMPONENTS}
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, least(vec_id, coalesce(low, vec_id)) AS component_id, vec_id <= coalesce(low, vec_id) AS kept
FROM vectors LEFT JOIN lowest ON vec_id = id LEFT JOIN (SELECT a, count(*) AS n FROM both_ GROUP BY a) AS counted ON vec_id = counted.a
"""

#: Bytes are pairs of hexadecimal digits here, so that substr() counts in bytes.
_OP3 = """
WITH texts AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
starts AS (SELECT doc_id, h, unnest(range(0, strlen(h) // 2 - 199)) AS i FROM texts),
strings AS (SELECT doc_id, i, md5(substr(h, 2 * i + 1, 400)) AS s FROM starts),
hits AS (SELECT doc_id, i, i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS gap FROM strings SEMI JOIN (SELECT s FROM strings GROUP BY s HAVING count(*) > 1) AS twice USING (s)),
numbered AS (SELECT doc_id, i, count_if(coalesce(gap, 999) > 200) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM hits),
runs AS (SELECT doc_id, min(i) AS a, max(i) + 200 AS b FROM numbered GROUP BY doc_id, k),
parts AS (SELECT doc_id, a, b, substr(h, 2 * coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) + 1, 2 * (a - coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0))) AS x, h FROM runs JOIN texts USING (doc_id)),
cut AS (SELECT doc_id, sum(b - a) AS removed, count(*) AS n, string_agg(x, '' ORDER BY a) || substr(any_value(h), 2 * max(b) + 1) AS x FROM parts GROUP BY doc_id)
SELECT doc_id, strlen(h) // 2 AS n_bytes, coalesce(removed, 0)::BIGINT AS n_removed, coalesce(n, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(x, h))) AS kept_sha256
FROM texts LEFT JOIN cut USING (doc_id)
"""

#: The table of the byte-wise CRC-32, and the checksum of an ASCII string by it.
_CRC_TABLE = "crc AS (SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i)) AS t)"


def _crc32(s: str) -> str:
    return f"xor(list_reduce(list_transform(string_split({s}, ''), lambda x: ascii(x)::BIGINT), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295), 4294967295)"


#: Edits are taken from the first turn on; of each state the least (cost, initials) stays, with the text so far.
_OP11 = f"""
WITH RECURSIVE {_CRC_TABLE},
given AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
hashed AS (SELECT *, {_crc32('k')} % 20 AS how FROM given, crc),
turns AS (SELECT conv_id, turn, CASE how WHEN 4 THEN 'user' ELSE role END AS role, CASE how WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE how WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM hashed),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i, rtrim(text, E' \\t\\n\\x0b\\x0c\\r') AS content FROM turns),
faulty AS (SELECT *, left(role, 1) AS r, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before, count(*) OVER (PARTITION BY conv_id) AS n,
  CASE WHEN content = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate' WHEN right(content, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault FROM placed),
moves(s, c, t, k) AS (VALUES (0, 'D', 0, 2), (1, 'D', 1, 2), (2, 'D', 2, 2), (3, 'D', 3, 2), (0, 'Ks', 1, 0), (0, 'Ku', 2, 0), (1, 'Ku', 2, 0), (2, 'Ka', 3, 0), (3, 'Ku', 2, 0), (0, 'R', 2, 1), (1, 'R', 2, 1), (2, 'R', 3, 1), (3, 'R', 2, 1)),
inserts(s, n, t, o) AS (SELECT s, 0, s, '' FROM range(4) AS x(s) UNION ALL SELECT s, n + 1, CASE WHEN t = 2 THEN 3 ELSE 2 END, o || CASE WHEN t = 2 THEN chr(10) || 'assistant:' ELSE chr(10) || 'user:' END FROM inserts WHERE n < 3),
walk AS (
  SELECT conv_id, 0::BIGINT AS i, 0 AS s, {{'cost': 0::BIGINT, 'audit': '', 'o': ''}} AS b FROM faulty WHERE i = 1
  UNION ALL
  SELECT w.conv_id, w.i + 1, m.t, min({{'cost': w.b.cost + 5 * x.n + m.k + CASE WHEN m.c <> 'D' AND f.fault = 'truncated' THEN 5 ELSE 0 END, 'audit': w.b.audit || repeat('I', x.n) || left(m.c, 1),
    'o': w.b.o || x.o || CASE WHEN m.c = 'D' THEN '' ELSE chr(10) || CASE WHEN m.c <> 'R' THEN f.role WHEN m.t = 3 THEN 'assistant' ELSE 'user' END || ':' || f.text END}})
  FROM walk w JOIN faulty f ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND f.i = w.i + 1 JOIN inserts x ON x.s = w.s
  JOIN moves m ON m.s = x.t AND (m.c = 'D' OR (f.fault NOT IN ('blank', 'duplicate') AND (m.c = 'R' OR m.c = 'K' || f.r)))
  GROUP BY ALL
),
best AS (SELECT w.conv_id, min({{'cost': w.b.cost + 5 * x.n, 'audit': w.b.audit || repeat('I', x.n), 'o': w.b.o || x.o}}) AS b FROM walk w JOIN inserts x ON x.s = w.s AND x.t IN (0, 3)
  WHERE w.i = (SELECT max(i) FROM faulty f WHERE f.conv_id IS NOT DISTINCT FROM w.conv_id) GROUP BY ALL),
counted AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count_if(fault = 'blank') AS blank, count_if(fault = 'duplicate') AS duplicate, count_if(fault = 'truncated') AS truncated,
  count_if(before || r NOT IN ('su', 'ua', 'au')) AS illegal FROM faulty GROUP BY conv_id)
SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal,
  coalesce(b.cost, 0)::BIGINT AS cost, coalesce(b.audit, '') AS audit, sha256(coalesce(substr(b.o, 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN counted c ON c.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN best ON best.conv_id IS NOT DISTINCT FROM o.conv_id
"""

_OP12 = """
WITH words AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
windows AS (SELECT doc_id, unnest(range(len(w) - 12)) AS i, unnest(list_transform(range(1, len(w) - 11), lambda i: md5(array_to_string(w[i:i + 12], ' ')))) AS x FROM words WHERE len(w) > 12),
late AS (SELECT doc_id, i FROM windows JOIN (SELECT x, min(doc_id) AS low FROM windows GROUP BY x) AS lowest USING (x) WHERE doc_id > low),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS i FROM late),
items AS (SELECT doc_id, unnest(range(len(w))) AS i, unnest(w) AS x FROM words),
kept AS (SELECT doc_id, count(*) AS n, string_agg(x, ' ' ORDER BY i) AS x FROM items ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(x, '')) AS kept_sha256 FROM words LEFT JOIN kept USING (doc_id)
"""

#: Pairs of equal words q apart that follow one another.
_OP13 = f"""
WITH {_CRC_TABLE},
words AS (SELECT doc_id, {_crc32('doc_id::VARCHAR')} AS h, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents, crc),
bent AS (SELECT *, len(w) AS n, (h // 10) % len(w) AS a, 1 + (len(w) - (h // 10) % len(w)) // (3 + (h // 10) % 8) AS p FROM words),
edited AS (SELECT doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN list_transform(range(n), lambda i: w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % p END]) ELSE w END AS w FROM bent),
items AS (SELECT doc_id, unnest(range(n)) AS i, unnest(w) AS x FROM edited),
equal AS (SELECT a.doc_id, a.i, b.i - a.i AS q FROM items a JOIN items b ON a.doc_id = b.doc_id AND a.x = b.x AND a.i < b.i),
numbered AS (SELECT doc_id, q, i, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS k FROM equal),
stretches AS (SELECT doc_id, q, min(i) AS s, max(i) + 1 + q AS e FROM numbered GROUP BY doc_id, q, k HAVING count(*) >= greatest(q, 12 - q)),
runs AS (SELECT doc_id, s, e - s AS n, min(q) AS q FROM stretches GROUP BY doc_id, s, e),
best AS (SELECT doc_id, count(*) AS n_runs, min({{'n': -n, 's': s, 'q': q}}) AS top, string_agg(s || ',' || n || ',' || q || chr(10), '' ORDER BY s, q) AS listed FROM runs GROUP BY doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(s + q, s + n)) AS i FROM runs),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY i) AS x FROM items ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, top.s::BIGINT AS start, (-top.n)::BIGINT AS length, top.q::BIGINT AS period, (1000 * -top.n // top.q)::BIGINT AS exponent_milli, sha256(coalesce(listed, '')) AS runs_sha256, sha256(coalesce(x, '')) AS collapsed_sha256
FROM documents d LEFT JOIN best USING (doc_id) LEFT JOIN kept USING (doc_id)
"""

#: The other seven run tokenizers or models that SQL can't express; tests/llm holds them against brute force.
ORACLE_SQL: dict[str, str] = {"op2_minhash_near_dedup": _OP2, "op3_suffix_array_dedup": _OP3, "op10_embedding_near_dedup": _OP10, "op11_conversation_repair": _OP11, "op12_window_dedup": _OP12, "op13_periodic_runs": _OP13}
