"""The registered queries of the text operators: each reads whole tables and calls its operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cwlight.llm import ann, decontam, divergence, langid, oracle, periodic, pieces, pii, secrets, toxicity, warc
from cwlight.llm.common import spread
from cwlight.llm.jaccard_join import jaccard_components
from cwlight.llm.near_dup import near_duplicates
from cwlight.llm.substring import remove_repeats


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents, dealt to all cores where they lie in too few partitions."""
    return spread(_table(spark, sf_dir, "documents"))


def tokenizer_path(name: str = "piece_bpe_32k.model") -> str:
    """Where the public tokenizer files lie on this machine and on the workers."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.languages(_documents(spark, sf_dir))


def op2_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(_table(spark, sf_dir, "embeddings"), k=10, every=100)


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(_documents(spark, sf_dir))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(_documents(spark, sf_dir), _table(spark, sf_dir, "labels"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(_documents(spark, sf_dir))


def op6_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(_table(spark, sf_dir, "documents"), with_text=False)


def op7_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.matches(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(_table(spark, sf_dir, "pages")).drop("url")


def op9_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode_decode(_documents(spark, sf_dir), tokenizer_path(), with_ids=False, with_text=False)


def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"))


def op11_periodic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.runs_in(periodic.with_echoes(_documents(spark, sf_dir)), with_runs=False, with_text=False)


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergence(_table(spark, sf_dir, "documents"))


def op13_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(_table(spark, sf_dir, "documents"))


def secrets_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the fixed patterns of op3 find, which SQL can say too."""
    return secrets.scan(_documents(spark, sf_dir), words=[]).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256")


def pii_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the fixed patterns of op5 find, which SQL can say too."""
    return pii.find(_documents(spark, sf_dir)).select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256")


QUERIES = {
    "op1_langid": op1_langid,
    "op2_nearest": op2_nearest,
    "op3_secrets": op3_secrets,
    "op4_toxicity": op4_toxicity,
    "op5_pii": op5_pii,
    "op6_substring": op6_substring,
    "op7_decontam": op7_decontam,
    "op8_warc": op8_warc,
    "op9_pieces": op9_pieces,
    "op10_minhash": op10_minhash,
    "op11_periodic": op11_periodic,
    "op12_divergence": op12_divergence,
    "op13_jaccard": op13_jaccard,
    "secrets_base": secrets_base,
    "pii_base": pii_base,
}
ORACLE = {
    "op6_substring": oracle.SUBSTRING,
    "op8_warc": oracle.WARC,
    "op10_minhash": oracle.NEAR_DUP,
    "op11_periodic": oracle.PERIODIC,
    "op12_divergence": oracle.DIVERGENCE,
    "op13_jaccard": oracle.JACCARD,
    "secrets_base": oracle.SECRETS_BASE,
    "pii_base": oracle.PII_BASE,
}
