"""The registered queries of this subpackage: one thin query per operator, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_grammar(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .token_grammar import read_back, write_grammar

    blocks = write_grammar(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return read_back(blocks)


def op2_external_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .external_shuffle import shard_digest

    return shard_digest(_table(spark, sf_dir, "documents"), shards=8)


def op3_pii_boosting(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii_boosting import find_pii

    return find_pii(_table(spark, sf_dir, "documents"), source_col="source")


def op4_secret_ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secret_ownership import find_secrets

    return find_secrets(_table(spark, sf_dir, "documents")).drop("places")


def op5_wu_manber(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .wu_manber import contamination

    return contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .byte_bpe import round_trip

    return round_trip(
        _table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    )


def op7_string_kernel(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .string_kernel import identify

    docs = _table(spark, sf_dir, "documents")
    return identify(docs, docs).drop("lead")


def op8_zstd_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .zstd_toxicity import toxicity

    return toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard_join import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_rules import quality

    return quality(_table(spark, sf_dir, "documents")).withColumn("failed_rules", F.array_join("failed_rules", ","))


def op11_reply_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .reply_trees import conversation_digest

    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    says = F.lit(r"\### Assistant: </turn> ok")
    kinds = dict(turns.dtypes)
    more = spark.range(2).select(
        F.lit(-7).cast(kinds["conv_id"]).alias("conv_id"), F.col("id").cast(kinds["turn"]).alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), says.alias("text")
    )
    return conversation_digest(turns.unionByName(more))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .periodic_runs import periodic_runs, run_digest, with_repeated_tails

    return run_digest(periodic_runs(with_repeated_tails(_table(spark, sf_dir, "documents"))))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .hard_negatives import hard_negatives

    vectors = _table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(vectors.withColumn("label", label), F.col("id") % 100 == 0)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_token_grammar": op1_token_grammar,
        "op2_external_shuffle": op2_external_shuffle,
        "op3_pii_boosting": op3_pii_boosting,
        "op4_secret_ownership": op4_secret_ownership,
        "op5_wu_manber": op5_wu_manber,
        "op6_byte_bpe": op6_byte_bpe,
        "op7_string_kernel": op7_string_kernel,
        "op8_zstd_toxicity": op8_zstd_toxicity,
        "op9_jaccard_join": op9_jaccard_join,
        "op10_quality_rules": op10_quality_rules,
        "op11_reply_trees": op11_reply_trees,
        "op12_periodic_runs": op12_periodic_runs,
        "op13_hard_negatives": op13_hard_negatives,
    }


def _quality_sql() -> str:
    """The measures and the threshold table in DuckDB's words; the table is read, not repeated."""
    from .quality_rules import RULES, STOP_WORDS

    stop = "|".join(sorted({w for ws in STOP_WORDS.values() for w in ws}))
    tests = []
    for r in RULES:
        ends = [f"{r.measure} < {r.low}"] * (r.low is not None) + [f"{r.measure} > {r.high}"] * (r.high is not None)
        tests.append(f"CASE WHEN {' OR '.join(ends)} THEN '{r.name}' END")
    return rf"""
WITH d AS (SELECT doc_id, row_number() OVER () AS rid, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT rid, i, array_to_string(w[i : i + 4], ' ') AS g FROM d, unnest(range(1, len(w) - 3)) AS r(i)),
twice AS (SELECT rid, g FROM win GROUP BY rid, g HAVING count(*) > 1),
hit AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest(range(i, i + 5)) AS p FROM win JOIN twice USING (rid, g)) GROUP BY rid),
l AS (SELECT rid, count(*) AS n_lines, count(*) - count(DISTINCT x) AS n_dup FROM (SELECT rid, unnest(string_split(t, chr(10))) AS x FROM d)
      WHERE regexp_matches(x, '[^\x20\x09-\x0D]') GROUP BY rid),
s AS (SELECT rid, count(*) AS n FROM (SELECT rid, unnest(w) AS x FROM d) WHERE regexp_matches(lower(x), '^(?:{stop})(?:[.,;:!?]|$)') GROUP BY rid),
m AS (SELECT doc_id, cast(len(w) AS BIGINT) AS n_words, cast(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
             cast(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, coalesce(n_dup, 0) AS n_dup_lines,
             coalesce(n_lines, 0) AS n_lines, coalesce(hit.n, 0) AS n_repeat_words, coalesce(s.n, 0) AS n_stop
      FROM d LEFT JOIN hit USING (rid) LEFT JOIN l USING (rid) LEFT JOIN s USING (rid)),
q AS (SELECT *, word_chars / greatest(n_words, 1) AS mean_word_length, n_symbols / greatest(n_words, 1) AS symbol_ratio, n_stop / greatest(n_words, 1) AS stop_ratio,
             n_repeat_words / greatest(n_words, 1) AS repeat_ratio, n_dup_lines / greatest(n_lines, 1) AS dup_line_ratio,
             n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m),
f AS (SELECT *, concat_ws(',', {", ".join(tests)}) AS failed_rules FROM q)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND failed_rules = '' AS kept, failed_rules FROM f
"""


#: DuckDB SQL by query name.
ORACLE_SQL: dict[str, str] = {
    "op9_jaccard_join": r"""
WITH RECURSIVE d AS (
  SELECT doc_id, row_number() OVER () AS rid,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x20\x09-\x0D]+') AS w
  FROM documents),
s AS (
  SELECT DISTINCT rid, array_to_string(w[i : i + 4], ' ') AS sh
  FROM d, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS r(i) WHERE len(w) > 0),
n AS (SELECT rid, count(*) AS n FROM s GROUP BY rid),
p AS (
  SELECT a.rid AS x, b.rid AS y, count(*) AS same
  FROM s a JOIN s b ON a.sh = b.sh AND a.rid <> b.rid GROUP BY a.rid, b.rid),
e AS (
  SELECT x, y FROM p JOIN n u ON u.rid = x JOIN n v ON v.rid = y
  WHERE 100 * same >= 75 * (u.n + v.n - same)),
c(rid, reached) AS (
  SELECT rid, rid FROM d
  UNION
  SELECT c.rid, e.y FROM c JOIN e ON e.x = c.reached),
m AS (SELECT c.rid, min(d.doc_id) AS component_id FROM c JOIN d ON d.rid = c.reached GROUP BY c.rid)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.component_id
FROM d LEFT JOIN n USING (rid) JOIN m USING (rid)
""",
    "op5_wu_manber": r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS rid,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
b AS (
  SELECT item_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') AS win
  FROM b, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS r(i) WHERE len(w) > 0),
lens AS (SELECT DISTINCT n FROM bw),
dw AS (
  SELECT rid, n, i, array_to_string(w[i : i + n - 1], ' ') AS win
  FROM d, lens, unnest(range(1, len(w) - n + 2)) AS r(i)),
m AS (SELECT rid, dw.n, i, item_id FROM dw JOIN bw ON dw.win = bw.win AND dw.n = bw.n),
h AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT rid, n, i FROM m)) GROUP BY rid),
t AS (SELECT rid, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS items FROM (SELECT DISTINCT rid, cast(item_id AS VARCHAR) AS s FROM m) GROUP BY rid)
SELECT d.doc_id, cast(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (rid) LEFT JOIN t USING (rid)
""",
}
ORACLE_SQL["op10_quality_rules"] = _quality_sql()
ORACLE_SQL["op11_reply_trees"] = r"""
WITH c AS (
  SELECT conv_id, turn, role, text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')),
t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS n FROM c),
e AS (SELECT *, length(text) + length(text) - length(replace(text, '\', '')) + (length(text) - length(replace(text, '<|', ''))) // 2 AS n_text,
             length(role) + length(role) - length(replace(role, '\', '')) + (length(role) - length(replace(role, '<|', ''))) // 2 AS n_role FROM t)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY n)) AS turns_sha256,
       cast(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY n) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       cast(sum(n_role + n_text + 23) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""
# The first ranks of each positive's window, over integer inner products; pairs of anchors and rows are all scored.
ORACLE_SQL["op13_hard_negatives"] = r"""
WITH v AS (
  SELECT row_number() OVER () AS rid, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * cast(x AS DOUBLE))) AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.rid, a.vec_id AS anchor_id, a.label = b.label AS same, b.vec_id, cast(list_inner_product(a.v, b.v) AS BIGINT) AS score
  FROM v a JOIN v b ON a.rid <> b.rid WHERE a.vec_id % 100 = 0),
p AS (
  SELECT rid, anchor_id, vec_id AS positive_id, score AS positive_score, row_number() OVER (PARTITION BY rid ORDER BY score DESC, vec_id) AS k
  FROM s WHERE same QUALIFY k <= 5),
n AS (
  SELECT p.anchor_id, positive_id, vec_id AS negative_id, positive_score, score AS negative_score,
         row_number() OVER (PARTITION BY p.rid, k ORDER BY score DESC, vec_id) AS rank
  FROM p JOIN s ON s.rid = p.rid AND NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score)
SELECT anchor_id, positive_id, cast(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5
"""
