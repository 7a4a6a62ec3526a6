"""The queries ``opN_<name>`` and what SQL can say of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import ann, clusters, html, licenses, lm, mixing, packing, quality, secrets, simhash, similarity, spelling, sql, warc


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.roundtrip(spark, _table(spark, sf_dir, "pages"))


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(_table(spark, sf_dir, "documents"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = quality.judge(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return d.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from plumbline.llm.store import new_dir

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    ledger = secrets.Ledger(spark, new_dir(spark, "secrets"))
    ledger.scan(docs)
    d = secrets.attach(docs, ledger)
    of = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    base = F.filter("spans", lambda s: s["kind_no"] < len(secrets.BASE_RULES))
    return d.select(
        "doc_id", of("assign").alias("n_assign"), of("access").alias("n_access"), of("hex").alias("n_hex"),
        F.sha2(secrets.span_text(base), 256).alias("base_sha256"), secrets.span_text(F.col("spans")).alias("spans"),
    )


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = mixing.mix(_table(spark, sf_dir, "documents"))
    return d.select("doc_id", "source", "lang", "topic", "n_tokens", "probability", "selected")


def op6_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = similarity.components(_table(spark, sf_dir, "documents"), k=4, num=85, den=100)
    return d.select("doc_id", "n_shingles", "component_id")


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = html.extract_pages(_table(spark, sf_dir, "pages"))
    return d.withColumn("n_chars", F.length("text").cast("long"))


def op8_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(_table(spark, sf_dir, "embeddings"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = licenses.scan(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return d.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), tokenizer_path)


def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.cluster(_table(spark, sf_dir, "embeddings"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(_table(spark, sf_dir, "documents"))


def op13_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.components(_table(spark, sf_dir, "documents"))


def queries() -> dict:
    found = {k: v for k, v in globals().items() if k.startswith("op") and callable(v)}
    return dict(sorted(found.items(), key=lambda x: int(x[0][2:].split("_")[0])))


def oracle_sql() -> dict[str, str]:
    return sql.oracle_sql()
