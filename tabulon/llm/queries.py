"""Registered queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulon.llm import (compression, covertree, mixing, pieces, pii, quality, secrets, simhash, spelling,
                         suffix_dedup, toxicity, wavelet, whitening)
from tabulon.llm.common import bound_batches, sha256_joined, text_or_empty

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql.strip()
        return fn
    return deco


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


# --------------------------------------------------------------------- secrets
def _base(kinds: tuple[str, ...]):
    return F.filter("spans", lambda s: s["kind"].isin(*kinds))


def _span_digest(found: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    """Per-kind counts and digests of ``spans``."""
    return found.select(
        F.col("row.doc_id").alias("doc_id"),
        *[F.size(_base((k,))).cast("long").alias(f"n_{k}") for k in kinds],
        F.sha2(sha256_joined(_base(kinds)), 256).alias("base_sha256"),
        sha256_joined(F.col("spans")).alias("spans"))


def _secrets_sql() -> str:
    """Every rule's matches by their lengths and those of the text between them."""
    each = []
    for i, r in enumerate(secrets.RULES):
        pattern = r.pattern.replace("}+", "}").replace("'", "''")  # no possessive repeats in this dialect
        value = f"regexp_extract(m[i], '{pattern}', {r.value})" if r.value else "m[i]"
        each.append(f"""SELECT n, {i} AS ord, '{r.kind}' AS kind, m[i] AS hit,
  coalesce(list_sum(list_transform(g[1:i], lambda x: length(x))), 0)
    + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS s
FROM (SELECT n, m, g, unnest(generate_series(1, len(m))) AS i FROM (
  SELECT n, regexp_extract_all(t, '{pattern}') AS m, string_split_regex(t, '{pattern}') AS g FROM d) a) b
WHERE length({value}) >= {r.min_value}""")
    base = ", ".join(f"'{k}'" for k in ("assign", "access", "hex"))
    text = "kind || ':' || s || ':' || (s + length(hit))"
    counts = ", ".join(f"count(*) FILTER (WHERE kind = '{k}') AS n_{k}" for k in ("assign", "access", "hex"))
    union = "\nUNION ALL\n".join(each)
    return f"""
WITH d AS (SELECT row_number() OVER () AS n, doc_id, coalesce(text, '') AS t FROM documents),
h AS ({union})
SELECT d.doc_id, {counts},
  sha256(coalesce(string_agg({text}, ',' ORDER BY s, ord) FILTER (WHERE kind IN ({base})), '')) AS base_sha256,
  coalesce(string_agg({text}, ',' ORDER BY s, ord), '') AS spans
FROM d LEFT JOIN h USING (n) GROUP BY d.n, d.doc_id"""


@register("op1_secret_scan", _secrets_sql())
def op1_secret_scan(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    return _span_digest(secrets.find_secrets(docs), ("assign", "access", "hex"))


# --------------------------------------------------------------------- simhash
@register("op6_simhash_dedup")
def op6_simhash_dedup(spark, d):
    found = simhash.grouped(table(spark, d, "documents"), keep=["doc_id"])
    return found.select(F.col("id").alias("doc_id"),
                        simhash.hex_fingerprint(F.col("fp")).alias("fingerprint"), "component_id")


# ---------------------------------------------------------------------- mixing
@register("op7_source_mixing", r"""
WITH d AS (SELECT row_number() OVER () AS n, doc_id, source, CASE WHEN source IS NULL THEN 1 ELSE 0 END AS none,
    len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
    md5(concat_ws(':', CAST(doc_id AS VARCHAR), md5(coalesce(text, '')))) AS digest FROM documents),
s AS (SELECT source, none, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source, none),
w AS (SELECT *, ([5.0, 2.0, 1.0]::DOUBLE[])[1 + (row_number() OVER (ORDER BY none, source) - 1) % 3] AS weight FROM s),
f AS (SELECT *, 3 * source_size / weight AS full_at FROM w),
l AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER b, 0))
    / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0)) AS here FROM f
  WINDOW b AS (ORDER BY full_at, none, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT *, max(CASE WHEN here <= full_at THEN here END) OVER () AS level FROM l),
g AS (SELECT source, none, source_size,
    CASE WHEN full_at <= level THEN CAST(3 * source_size AS DOUBLE) ELSE weight * level END AS target FROM t),
e AS (SELECT n, source, none, size, epoch, md5(concat_ws(':', digest, CAST(epoch AS VARCHAR))) AS turn
  FROM d, range(3) r(epoch)),
c AS (SELECT *, sum(size) OVER (PARTITION BY none, source ORDER BY epoch, turn, size, n) - size AS earlier FROM e),
k AS (SELECT n, sum(least(size, greatest(0, round(target) - earlier))) AS taken
  FROM c JOIN g ON c.none = g.none AND c.source IS NOT DISTINCT FROM g.source GROUP BY n)
SELECT d.doc_id, d.size, g.source_size, round(g.target, 6) AS target, CAST(k.taken AS BIGINT) AS taken
FROM d JOIN k USING (n) JOIN g ON d.none = g.none AND d.source IS NOT DISTINCT FROM g.source
""")
def op7_source_mixing(spark, d):
    found = mixing.mix(table(spark, d, "documents"), keep=["doc_id"])
    return found.select("row.doc_id", "size", "source_size", F.round("target", 6).alias("target"), "taken")


# --------------------------------------------------------------- sentencepiece
def tokenizer_file(name: str) -> str:
    """Place of a vocabulary file; the operators take its content."""
    import public_tokenizers
    return public_tokenizers.path(name)


def file_bytes(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


@register("op3_sentencepiece")
def op3_sentencepiece(spark, d):
    bound_batches(spark)
    model = file_bytes(tokenizer_file("piece_bpe_32k.model"))
    docs = table(spark, d, "documents")
    found = docs.select("doc_id", pieces.encoded(text_or_empty("text"), model).alias("e"))
    return found.select("doc_id", pieces.token_count(F.col("e.ids")).alias("n_tokens"),
                        F.sha2("e.ids", 256).alias("ids_sha256"),
                        F.sha2("e.decoded", 256).alias("decoded_sha256"),
                        F.sha2("e.bounds", 256).alias("bounds_sha256"))


# --------------------------------------------------------------------- quality
@register("op8_quality_rules")
def op8_quality_rules(spark, d):
    bound_batches(spark)
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels")
    return quality.judged(docs, labels).select(
        "row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept", F.round("good", 6).alias("good"))


# -------------------------------------------------------------------- toxicity
def _held_out(doc_id):
    return F.pmod(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")), F.lit(4)) == 2


@register("op9_toxicity")
def op9_toxicity(spark, d):
    bound_batches(spark)
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels")
    found = toxicity.toxic_documents(docs.select("doc_id", "text"), labels, ~_held_out(F.col("id")))
    return found.select(F.col("row.doc_id").alias("doc_id"),
                        F.coalesce(_held_out(F.col("row.doc_id")), F.lit(False)).alias("held_out"),
                        "score", F.col("predicted").cast("int").alias("predicted"), "spans")


# ---------------------------------------------------------------- wavelet shards
@register("op10_token_shards")
def op10_token_shards(spark, d):
    model = file_bytes(tokenizer_file("word_bpe_49k.json"))
    files = wavelet.write_shards(table(spark, d, "documents"), model, end_id=1)
    return wavelet.read_documents(files)


# ------------------------------------------------------------------ top-k search
@register("op4_exact_top_k", """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score
      FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM s)
SELECT query_id, n::INTEGER AS rank, vec_id, score FROM r WHERE n <= 10
""")
def op4_exact_top_k(spark, d):
    return covertree.top_k(table(spark, d, "embeddings"), "vec_id % 100 = 0")


# ----------------------------------------------------------------- personal data
@register("op5_personal_data")
def op5_personal_data(spark, d):
    return _span_digest(pii.find_personal(table(spark, d, "documents"), keep=["doc_id"]), pii.KINDS)


# ------------------------------------------------------------- repeated substrings
@register("op2_suffix_dedup")
def op2_suffix_dedup(spark, d):
    found = suffix_dedup.without_repeats(table(spark, d, "documents"), keep=["doc_id"])
    return found.select("row.doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


# ------------------------------------------------------------ compression classifier
def _unlearnt(doc_id):
    return F.pmod(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")), F.lit(3)) == 1


@register("op11_quality_classifier")
def op11_quality_classifier(spark, d):
    bound_batches(spark)
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels")
    found = compression.scored(docs.select("doc_id", "text"), labels, "quality", ~_unlearnt(F.col("id")))
    return found.select(F.col("row.doc_id").alias("doc_id"),
                        F.coalesce(_unlearnt(F.col("row.doc_id")), F.lit(False)).alias("held_out"),
                        "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "difference")


# ----------------------------------------------------------------------- whitening
@register("op12_embedding_whitening")
def op12_embedding_whitening(spark, d):
    return whitening.whiten(table(spark, d, "embeddings")).withColumnRenamed("id", "vec_id")


# ----------------------------------------------------------------- spelling variants
@register("op13_spelling_variants")
def op13_spelling_variants(spark, d):
    bound_batches(spark)
    words = spelling.vocabulary(table(spark, d, "documents"), min_length=5, min_count=3, noise=97)
    return spelling.variants(words, ratio=2, min_length=5)
