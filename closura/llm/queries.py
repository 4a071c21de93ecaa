"""The operators as registered queries: opN_<name>(spark, sf_dir)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import decontaminate, language_id, license_scan, near_dedup, packing, quality_model, quality_rules, secret_scan, sharding, spelling, suffix_dedup, token_counts, whitening
from .common import table


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_model.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language_id.fit(docs.where(~language_id.held_out()))
    return language_id.predict(docs, model, language_id.held_out().alias("held_out"))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup.cleaned(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), (F.col("n_removed") > 0).alias("has_repeats"))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = secret_scan.scan(table(spark, sf_dir, "documents"))
    joined = lambda x: F.array_join(F.transform(x, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("spans", lambda s: s["kind"] != "crf")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return out.select("doc_id", *[count(k) for k in secret_scan.KINDS], F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def op5_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.classes(table(spark, sf_dir, "documents"))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = license_scan.scan(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.size("licenses").cast("long").alias("n_licenses"), "licenses")


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.packed(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of every text, then of the text after two edits: its second third loses its
    first 16 characters, and " edited" is put in at two thirds of what is left."""
    import public_tokenizers

    n = F.coalesce(F.length("text"), F.lit(0))
    cut_at = F.floor(n / 3)
    put_at = F.floor((n - F.least(F.lit(16), n - cut_at)) * 2 / 3)
    edit = lambda a, b, text: F.struct(a.alias("start"), b.alias("end"), F.lit(text).alias("text"))
    docs = table(spark, sf_dir, "documents").withColumn("edits", F.array(edit(cut_at, cut_at + 16, ""), edit(put_at, put_at, " edited")))
    return token_counts.count(docs, public_tokenizers.path("byte_bpe_50k.json")).drop("tree_chars", "tree_tokens")


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "item_ids", "share", (F.size("item_ids") == 0).alias("kept"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules.judge(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "d2")


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened(table(spark, sf_dir, "embeddings"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.grouped(table(spark, sf_dir, "documents"))


def op13_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.sharded(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "home")


def queries() -> dict:
    return {k: v for k, v in globals().items() if k.startswith("op") and k[2].isdigit()}


#: Documents' words, shingles, links and who is reached by them.
_OP5 = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
x AS (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, CASE WHEN len(w) > 0 THEN 2 ELSE 1 END))) AS i FROM d),
sh AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g FROM x),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sh a JOIN sh b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS MATERIALIZED (SELECT a, b FROM p JOIN n s ON s.doc_id = a JOIN n t ON t.doc_id = b WHERE 100 * c >= 85 * (s.n + t.n - c)),
q AS MATERIALIZED (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT doc_id AS u, doc_id AS v FROM documents UNION SELECT r.u, q.b FROM r JOIN q ON q.a = r.v),
c AS (SELECT u, min(v) AS low FROM r GROUP BY u)
SELECT documents.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, c.low AS component_id, c.low = documents.doc_id AS kept
FROM documents JOIN c ON c.u = documents.doc_id LEFT JOIN n ON n.doc_id = documents.doc_id
"""

#: Strings of 400 bytes as 800 hexadecimal digits, the runs that repeated ones cover, and
#: what is between them.
_OP3 = """
WITH d AS MATERIALIZED (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
s AS MATERIALIZED (SELECT doc_id, i, md5(substr(h, CAST(2 * i + 1 AS BIGINT), 800)) AS k FROM (SELECT doc_id, h, unnest(range(0, greatest(0, len(h) // 2 - 399))) AS i FROM d)),
m AS (SELECT doc_id, i FROM s WHERE k IN (SELECT k FROM s GROUP BY k HAVING count(*) > 1)),
f AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 400 THEN 0 ELSE 1 END AS new FROM m),
g AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS run FROM f),
runs AS (SELECT doc_id, run, min(i) AS lo, max(i) + 400 AS hi FROM g GROUP BY doc_id, run),
gaps AS (SELECT doc_id, lo, hi, coalesce(lag(hi) OVER (PARTITION BY doc_id ORDER BY lo), 0) AS back FROM runs),
parts AS (SELECT doc_id, count(*) AS n, sum(hi - lo) AS removed, max(hi) AS top, string_agg(substr(h, CAST(2 * back + 1 AS BIGINT), CAST(2 * (lo - back) AS BIGINT)), '' ORDER BY lo) AS kept FROM gaps JOIN d USING (doc_id) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n, 0) AS BIGINT) AS n_spans,
sha256(unhex(coalesce(kept, '') || substr(h, CAST(2 * coalesce(top, 0) + 1 AS BIGINT)))) AS kept_sha256, coalesce(removed, 0) > 0 AS has_repeats
FROM d LEFT JOIN parts USING (doc_id)
"""

#: The others learn or pack by methods that SQL can't express; their tests hold them against
#: brute force, the library's own encoding, or held-out material.
ORACLE_SQL: dict[str, str] = {"op3_suffix_dedup": _OP3, "op5_minhash_near_dedup": _OP5}
