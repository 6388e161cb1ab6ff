"""Registered queries of the operators, and their SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointlake.llm import bpe, chat, fim, language, lexical, mixing, mtree, multiset, pii, quality, sharding, simhash, substrings
from pointlake.llm.common import table

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
SHARD_BYTES = 1 << 20


def op1_mtree_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = mtree.integer_vectors(table(spark, sf_dir, "embeddings"))
    queries = vectors.filter(F.col("vec_id") % 50 == 0).select(F.col("vec_id").alias("query_id"), "v")
    return mtree.top_k(vectors, queries, 5)


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substrings.deduplicate(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    prototypes = language.learn(docs.filter(~language.held_out(F.col("doc_id"))))
    out = language.predict(docs.select("doc_id", "text", language.held_out(F.col("doc_id")).alias("held_out")), prototypes, keep=False)
    return out.select("doc_id", "held_out", "lang_pred", "score")


def op4_chat_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.rotate(table(spark, sf_dir, "conversations"))


def op5_pii_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_spans(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("spans", lambda s: s["base"])
    counts = [pii.count_of("spans", k).alias(f"n_{k}") for k in ("email", "ip", "card", "phone")]
    return found.select("doc_id", *counts, F.sha2(pii.listed(base), 256).alias("base_sha256"), pii.listed(F.col("spans")).alias("spans"))


def op6_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), keep=False)


def op7_extendible_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shards(table(spark, sf_dir, "documents").select("doc_id", "text"), SHARD_BYTES)


def op8_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = bpe.round_trip(table(spark, sf_dir, "documents").select("doc_id", "text"), VOCABULARY, keep=False)
    return both.select("doc_id", bpe.n_ids(F.col("ids")).alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op9_suffix_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.judge(quality.quality_measures(table(spark, sf_dir, "documents").select("doc_id", "text"), keep=False))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_covered", "longest_repeat")


def op10_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    out = mixing.attach_plan(docs, mixing.plan(docs))
    return out.select("row.doc_id", "size", "source_size", "target", (F.col("size") * F.size("takes")).alias("taken"), F.transform("takes", lambda t: t["shard"]).alias("shards"))


def op11_multiset_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = multiset.compare_with_next(table(spark, sf_dir, "documents"))
    return out.withColumns({c: F.lower(F.hex(c)) for c in ("fingerprint", "edited_fingerprint")})


def op12_lexical_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), 10)


def op13_fim_regex(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fim.transform(table(spark, sf_dir, "documents").select("doc_id", "text"))
    back = fim.restored(F.col("output"), F.col("form"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_mtree_topk, op2_substring_dedup, op3_language_id, op4_chat_rotation, op5_pii_spans, op6_simhash_groups,
                            op7_extendible_shards, op8_bpe_round_trip, op9_suffix_quality, op10_source_mix, op11_multiset_fingerprint, op12_lexical_scan, op13_fim_regex, pipeline)}

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

ORACLE: dict[str, str] = {
    "op1_mtree_topk": """
WITH u AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
  FROM u q JOIN u c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5""",
    "op4_chat_rotation": """
WITH u AS (SELECT DISTINCT conv_id, turn, coalesce(role, 'unknown') AS who, coalesce(text, '') AS said FROM conversations),
r AS (SELECT *, (place - place % 64) // 64 AS part FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS LAST, who, md5(said)) - 1 AS place FROM u)),
p AS (SELECT DISTINCT conv_id, who AS assistant FROM r WHERE who <> 'system'),
s AS (SELECT r.*, assistant, CASE WHEN who = 'system' THEN '<|system|>' WHEN who = assistant THEN '<|assistant|>' ELSE '<|user:' || who || '|>' END || chr(10) AS head,
    said || '<|end|>' || chr(10) AS body FROM r JOIN p ON r.conv_id IS NOT DISTINCT FROM p.conv_id),
o AS (SELECT *, coalesce(sum(length(head) + length(body)) OVER (PARTITION BY conv_id, assistant, part ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + length(head) AS a FROM s)
SELECT conv_id, assistant, part, count(*) AS n_turns, string_agg(head || body, '' ORDER BY place) AS text,
  coalesce(string_agg(CASE WHEN who = assistant THEN CAST(a AS BIGINT) || ':' || CAST(a + length(said) AS BIGINT) END, ',' ORDER BY place), '') AS mask
FROM o GROUP BY conv_id, assistant, part""",
    "op12_lexical_scan": r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS u FROM documents),
s AS (SELECT CAST(count(*) AS BIGINT) AS nd, CAST(sum(len(u)) AS BIGINT) AS nt FROM d WHERE len(u) > 0),
i AS (SELECT item_id, term, count(*) AS k FROM (SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM (SELECT DISTINCT item_id, text FROM benchmark)) GROUP BY ALL),
f AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(u) AS term FROM d) WHERE term IN (SELECT term FROM i) GROUP BY ALL),
w AS (SELECT term, CAST(floor(1000 * ln((2 * nd + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM f, s GROUP BY term, nd),
m AS (SELECT r, doc_id, 25 + (75 * CAST(len(u) AS BIGINT) * nd) // nt AS m FROM d, s WHERE len(u) > 0),
x AS (SELECT item_id, r, doc_id, CAST(sum(k * w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score FROM i JOIN f USING (term) JOIN w USING (term) JOIN m USING (r) GROUP BY ALL)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM x WHERE score > 0) WHERE rank <= 10""",
    "op13_fim_regex": r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS x,
    regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u FROM documents),
h AS (SELECT *, CAST(len(u) AS BIGINT) AS n, list_transform([1, 9, 17, 25], lambda k: CAST('0x' || substr(x, k, 8) AS BIGINT)) AS h FROM d),
f AS (SELECT *, least(h[1] % (n + 1), h[2] % (n + 1)) AS a, greatest(h[1] % (n + 1), h[2] % (n + 1)) AS b,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h[3] % 100 >= 50 THEN 'plain' WHEN h[4] % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM h),
c AS (SELECT *, coalesce(array_to_string(u[1:a], ''), '') AS p, coalesce(array_to_string(u[a + 1:b], ''), '') AS m, coalesce(array_to_string(u[b + 1:], ''), '') AS s FROM f)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256 FROM c""",
    "op7_extendible_shards": f"""
WITH d AS (SELECT doc_id, CAST(coalesce(strlen(text), 0) AS BIGINT) AS bytes,
    lpad(bin(CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT)), 60, '0') AS bits FROM documents),
l AS (SELECT doc_id, bytes, depth, substr(bits, 1, depth) AS shard FROM d, (SELECT CAST(unnest(range(61)) AS INTEGER) AS depth)),
b AS (SELECT depth, shard, CAST(sum(bytes) AS BIGINT) AS shard_bytes FROM l GROUP BY ALL HAVING sum(bytes) <= {SHARD_BYTES} OR count(*) = 1)
SELECT doc_id, bytes, depth, shard, shard_bytes FROM (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY depth) AS k FROM l JOIN b USING (depth, shard)) WHERE k = 1""",
}
