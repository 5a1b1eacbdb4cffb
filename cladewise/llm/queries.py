"""The opN_ queries: thin views of the operators' results, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat_format, decontaminate, jaccard_join, merkle, permutation_index, quality, sentencepiece_viterbi, substring_dedup, suffix_dedup, token_counts, toxicity, vector_codes, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    out_of_fold = F.pmod(toxicity.fold(), F.lit(5)) == 0
    labels = table(spark, sf_dir, "labels").where(~out_of_fold)
    out = toxicity.score_toxicity(table(spark, sf_dir, "documents"), labels)
    return out.select("doc_id", F.coalesce(out_of_fold, F.lit(False)).alias("held_out"), "score", "predicted", "votes")


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    out_of_fold = F.pmod(toxicity.fold(), F.lit(4)) == 2
    labels = table(spark, sf_dir, "labels").where(~out_of_fold)
    out = quality.score_quality(table(spark, sf_dir, "documents"), labels)
    return out.select("doc_id", F.coalesce(out_of_fold, F.lit(False)).alias("held_out"), "score", "predicted")


def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.dedup_substrings(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op6_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = jaccard_join.jaccard_components(table(spark, sf_dir, "documents"), n=3, num=90, den=100)
    return out.select("doc_id", "n_shingles", "component_id")


def op7_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup.dedup_suffixes(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_viterbi.encode(table(spark, sf_dir, "documents"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = warc.archive(table(spark, sf_dir, "pages"))
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_permutation_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return permutation_index.nearest(vectors, vectors.where("vec_id % 20 = 0"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = vector_codes.compress(table(spark, sf_dir, "embeddings"))
    return out.select("vec_id", "code", "error", "label_error", "codebooks_sha256")


#: A conversation whose texts hold an escape character and what looks like control strings.
TRAP = r"\### Assistant: </turn> ok"


def op12_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    rows = rows.unionByName(chat_format.added_conversation(-7, [("user", TRAP), ("assistant", TRAP)], spark))
    return chat_format.read_back(chat_format.format_chats(rows))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.verified(merkle.manifest(table(spark, sf_dir, "documents")))


def queries() -> dict:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


#: SQL twins, for DuckDB, where whole tables are not too slow for it. The others (1, 2, 3, 7, 8, 10) are tested
#: against brute force, round trips, held-out rows and recall in tests/llm.
_LOW = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = "coalesce(regexp_extract_all(" + _LOW + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), [])"
_PLAIN = r"coalesce(regexp_extract_all({}, '[^\x20\x09-\x0D]+'), [])"

_ESCAPED = r"regexp_replace(replace({}, '\', '\\'), '<(turn>|says>|more>|/turn>\n)', '<\\\1', 'g')"


def _leaf(n_chars: str) -> str:
    field = lambda x: f"coalesce(strlen(CAST({x} AS VARCHAR)) || ':' || CAST({x} AS VARCHAR), '-')"
    return f"sha256({' || '.join(field(x) for x in ('doc_id', 'source', 'lang', n_chars, 'text'))})"


#: The table of CRC-32, from its rule, as column crc.
_CRC = "(SELECT list(list_reduce(list_concat([i], [CAST(0 AS BIGINT) FOR k IN range(8)]), lambda c, k: xor(c >> 1, (c & 1) * 3988292384)) ORDER BY i) AS crc FROM (SELECT unnest(range(256)) AS i))"


def _crc32(text: str) -> str:
    return f"xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)], [CAST(ascii(x) AS BIGINT) FOR x IN string_split({text}, '')]), lambda c, b: xor(c >> 8, crc[1 + (xor(c, b) & 255)])), 4294967295)"


def _kmeans(parts: int, entries: int, rounds: int, scale: int) -> str:
    """Assignments and means in turn, a pair of tables a round; floor division is exact."""
    out = f"""
WITH v AS (SELECT vec_id, label, [CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS x FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
 p AS MATERIALIZED (SELECT vec_id, pos // w AS part, pos % w AS place, x FROM (SELECT vec_id, len(x) // {parts} AS w, unnest(x) AS x, unnest(range(len(x))) AS pos FROM v)),
 b0 AS (SELECT part, place, x, dense_rank() OVER (ORDER BY vec_id) - 1 AS entry FROM p WHERE vec_id IN (SELECT vec_id FROM v ORDER BY vec_id LIMIT {entries}))"""
    for k in range(rounds + 1):
        out += f""",
 a{k} AS MATERIALIZED (SELECT vec_id, part, min([d, entry]) AS best FROM (SELECT vec_id, p.part, entry, CAST(sum((p.x - b.x) * (p.x - b.x)) AS BIGINT) AS d FROM p JOIN b{k} b ON b.part = p.part AND b.place = p.place GROUP BY 1, 2, 3) GROUP BY 1, 2)"""
        if k < rounds:
            out += f""",
 m{k} AS (SELECT p.part, best[2] AS entry, place, CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM p JOIN a{k} a ON a.vec_id = p.vec_id AND a.part = p.part GROUP BY 1, 2, 3),
 b{k + 1} AS MATERIALIZED (SELECT b.part, b.place, coalesce((s - ((s % n) + n) % n) // n, b.x) AS x, b.entry FROM b{k} b LEFT JOIN m{k} m ON m.part = b.part AND m.entry = b.entry AND m.place = b.place)"""
    return out + f""",
 e AS (SELECT vec_id, string_agg(printf('%02x', best[2]), '' ORDER BY part) AS code, CAST(sum(best[1]) AS BIGINT) AS error FROM a{rounds} GROUP BY 1)
SELECT e.vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, (SELECT sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY part, entry, place)) FROM b{rounds}) AS codebooks_sha256 FROM e JOIN v ON v.vec_id = e.vec_id"""


ORACLE: dict[str, str] = {
    "op4_benchmark_decontamination": f"""
WITH b AS (SELECT item_id, {_WORDS.format("text")} AS w FROM benchmark),
 bw AS (SELECT DISTINCT item_id, w[s:s + least(13, len(w)) - 1] AS g FROM (SELECT item_id, w, unnest(generate_series(1, greatest(len(w) - 12, 1))) AS s FROM b WHERE len(w) > 0)),
 d AS (SELECT doc_id, {_WORDS.format("text")} AS w FROM documents),
 sizes AS (SELECT DISTINCT len(g) AS n FROM bw),
 dw AS (SELECT doc_id, s, n, w[s:s + n - 1] AS g FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS s FROM d, sizes WHERE len(w) >= n)),
 m AS (SELECT doc_id, s, n, item_id FROM dw JOIN bw USING (g)),
 h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(s, s + n - 1)) AS p FROM m) GROUP BY 1),
 i AS (SELECT doc_id, count(*) AS n_items, string_agg(k, ',' ORDER BY k) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS k FROM m) GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
 coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated FROM d LEFT JOIN h ON h.doc_id = d.doc_id LEFT JOIN i ON i.doc_id = d.doc_id""",
    "op5_substring_dedup": f"""
WITH d AS (SELECT doc_id, {_PLAIN.format("text")} AS w FROM documents),
 v AS (SELECT doc_id, s, hash(w[s:s + 12]) AS g FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 12)) AS s FROM d WHERE len(w) >= 13)),
 r AS (SELECT doc_id, s FROM (SELECT *, min(doc_id) OVER (PARTITION BY g) AS f FROM v) WHERE f < doc_id),
 x AS (SELECT DISTINCT doc_id, unnest(generate_series(s, s + 12)) AS p FROM r),
 k AS (SELECT doc_id, unnest(w) AS t, unnest(generate_series(1, len(w))) AS p FROM d),
 j AS (SELECT k.doc_id, string_agg(t, ' ' ORDER BY k.p) AS kept FROM k ANTI JOIN x ON x.doc_id = k.doc_id AND x.p = k.p GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN j ON j.doc_id = d.doc_id LEFT JOIN (SELECT doc_id, count(*) AS n FROM x GROUP BY 1) c ON c.doc_id = d.doc_id""",
    "op6_ngram_jaccard_join": f"""
WITH RECURSIVE d AS (SELECT doc_id, {_PLAIN.format(_LOW.format("text"))} AS w FROM documents),
 s AS (SELECT DISTINCT doc_id, hash(w[k:k + 2]) AS g FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(len(w) - 2, 1))) AS k FROM d WHERE len(w) > 0)),
 n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
 e AS (SELECT x.doc_id AS a, y.doc_id AS b FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id JOIN n p ON p.doc_id = x.doc_id JOIN n q ON q.doc_id = y.doc_id
  WHERE 10 * least(p.n, q.n) >= 9 * greatest(p.n, q.n) GROUP BY x.doc_id, y.doc_id, p.n, q.n HAVING 100 * count(*) >= 90 * (p.n + q.n - count(*))),
 c AS (SELECT doc_id AS a, doc_id AS b FROM n UNION SELECT c.a, e.b FROM c JOIN e ON c.b = e.a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(m.component_id, d.doc_id) AS component_id FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN (SELECT a, min(b) AS component_id FROM c GROUP BY 1) m ON m.a = d.doc_id""",
    "op11_vector_codes": _kmeans(vector_codes.PARTS, vector_codes.ENTRIES, vector_codes.ROUNDS, vector_codes.SCALE),
    "op12_chat_format": rf"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, k, role, '{TRAP}' FROM (VALUES (0, 'user'), (1, 'assistant')) AS t(k, role)),
 e AS (SELECT *, length({_ESCAPED.format("role")}) AS role_n, length({_ESCAPED.format("text")}) AS text_n,
  role IS DISTINCT FROM lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS opens FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
 CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
 CAST(sum(text_n + CASE WHEN opens THEN length('<turn><says></turn>') + 1 + role_n ELSE length('<more>') END) AS BIGINT) AS formatted_chars FROM e GROUP BY conv_id""",
    "op13_merkle_manifest": f"""
WITH RECURSIVE d AS (SELECT doc_id, lang, {_leaf("n_chars")} AS leaf, CASE WHEN {_crc32("CAST(doc_id AS VARCHAR)")} % 7 = 0 THEN {_leaf("n_chars + 1")} END AS other FROM documents, {_CRC}),
 a AS (SELECT doc_id, lang, leaf, coalesce(other, leaf) AS trial, row_number() OVER (PARTITION BY lang ORDER BY doc_id, leaf) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n FROM d),
 low(lvl, lang, pos, digest, n) AS (SELECT 0, lang, pos, leaf, n FROM a
  UNION ALL SELECT lvl + 1, lang, pos // 2, sha256(string_agg(digest, '' ORDER BY pos)), any_value((n + 1) // 2) FROM low WHERE n > 1 GROUP BY lvl, lang, pos // 2),
 sub AS (SELECT lang, digest, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM low WHERE n = 1),
 top(lvl, pos, digest, n) AS (SELECT 0, pos, digest, n FROM sub
  UNION ALL SELECT lvl + 1, pos // 2, sha256(string_agg(digest, '' ORDER BY pos)), any_value((n + 1) // 2) FROM top WHERE n > 1 GROUP BY lvl, pos // 2),
 up(doc_id, leaf, trial, lang, lvl, pos, n, node, proof) AS (SELECT doc_id, leaf, trial, lang, 0, pos, n, trial, '' FROM a
  UNION ALL SELECT doc_id, leaf, trial, u.lang, u.lvl + 1, u.pos // 2, (u.n + 1) // 2, sha256(CASE WHEN u.pos % 2 = 1 THEN s.digest || node ELSE node || coalesce(s.digest, '') END), proof || coalesce(s.digest, '')
  FROM up u LEFT JOIN low s ON s.lang IS NOT DISTINCT FROM u.lang AND s.lvl = u.lvl AND s.pos = xor(u.pos, 1) WHERE u.n > 1),
 over(doc_id, leaf, subroot, lvl, pos, n, node, proof) AS (SELECT doc_id, leaf, digest, 0, sub.pos, sub.n, node, proof FROM up JOIN sub ON sub.lang IS NOT DISTINCT FROM up.lang WHERE up.n = 1
  UNION ALL SELECT doc_id, leaf, subroot, u.lvl + 1, u.pos // 2, (u.n + 1) // 2, sha256(CASE WHEN u.pos % 2 = 1 THEN s.digest || node ELSE node || coalesce(s.digest, '') END), proof || coalesce(s.digest, '')
  FROM over u LEFT JOIN top s ON s.lvl = u.lvl AND s.pos = xor(u.pos, 1) WHERE u.n > 1)
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, node AS folded_root, node = root AS verified FROM over, (SELECT digest AS root FROM top WHERE n = 1) WHERE over.n = 1""",
    "op9_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages), q AS (SELECT page_id, strlen(h) AS n, sha256(h) AS g, min(page_id) OVER (PARTITION BY h) AS f FROM p)
SELECT page_id, n AS payload_bytes, g AS payload_digest, CASE WHEN n >= 100 AND page_id > f THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN n >= 100 AND page_id > f THEN f END AS refers_to FROM q""",
}
