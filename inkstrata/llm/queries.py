"""Queries and oracle SQL of the training-data operators."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    bpe,
    cdc_dedup,
    decontaminate,
    divergence,
    language_id,
    mixing,
    phrases,
    prob_minhash,
    quality_rules,
    secret_scan,
    suffix_array,
    token_counts,
    url_filters,
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary_path() -> str:
    """The vocabulary of the token-count query: the environment's, or the public tokenizers' folder."""
    return os.environ.get("INKSTRATA_VOCABULARY", "/opt/tokenizers/piece_bpe_32k.model")


def tokenizer_path() -> str:
    """The tokenizer file of the BPE query: the environment's, or the public tokenizers' folder."""
    return os.environ.get("INKSTRATA_TOKENIZER", "/opt/tokenizers/byte_bpe_50k.json")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "documents"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts.count_tokens(documents, vocabulary_path()).drop("text")


def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filters.judge(table(spark, sf_dir, "pages"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digest(table(spark, sf_dir, "documents"))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), ["doc_id"])


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_prob_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prob_minhash.classes(table(spark, sf_dir, "documents"))


def op9_cdc_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cdc_dedup.repeated_spans(table(spark, sf_dir, "documents"))


def op10_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_array.matches(table(spark, sf_dir, "documents"))


def op11_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digest(table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_path())


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.mine(table(spark, sf_dir, "documents"))


def contract_op4_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op4 that its rules fix: sizes and targets."""
    return op4_mixing(spark, sf_dir).select("doc_id", "size", "source_size", F.round("target", 4).alias("target"))


def contract_op5_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op5 that its rules fix and SQL can count."""
    return op5_secret_scan(spark, sf_dir).select("doc_id", "n_assign", "n_access", "n_hex")


def contract_op7_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op7 that its rules fix, and that no document is kept that they fail."""
    out = op7_quality_rules(spark, sf_dir)
    base = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    return out.select("doc_id", *base, (F.col("kept") & F.col("base_failed")).alias("kept_though_failed"))


def redirected(pages: DataFrame) -> DataFrame:
    """Pages with a canonical link or a refresh redirect planted behind their html, or none, by id."""
    number = lambda n: F.floor(F.col("page_id") / n).cast("string")
    hub = F.concat(F.lit('<link rel="canonical" href="http://hub'), number(4), F.lit('.example.com/de/x?utm_source=a&amp;k=1">'))
    chain = F.concat(F.lit("<META http-equiv='refresh' content='0; url=//site"), number(6), F.lit(".example.org/fr/../y.html#top'>"))
    near = F.lit("<link href=../z/ rel=canonical>")
    planted = F.when(F.col("page_id") % 5 == 0, hub).when(F.col("page_id") % 5 == 1, chain).when(F.col("page_id") % 5 == 2, near).otherwise("")
    return pages.withColumn("html", F.concat(F.coalesce("html", F.lit("")), planted, F.when(F.col("page_id") % 7 == 0, chain).otherwise("")))


SQL_REDIRECTED = """planted AS (
  SELECT page_id, url, coalesce(html, '') || CASE page_id % 5 WHEN 0 THEN hub WHEN 1 THEN chain WHEN 2 THEN '<link href=../z/ rel=canonical>' ELSE '' END
    || CASE WHEN page_id % 7 = 0 THEN chain ELSE '' END AS html
  FROM (SELECT *, '<link rel="canonical" href="http://hub' || page_id // 4 || '.example.com/de/x?utm_source=a&amp;k=1">' AS hub,
    '<META http-equiv=''refresh'' content=''0; url=//site' || page_id // 6 || '.example.org/fr/../y.html#top''>' AS chain FROM pages)
), urls AS ("""


def contract_op3_redirects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op3 on pages with planted links, so that components of aliases carry blocks, and allows hold them off."""
    return url_filters.judge(redirected(table(spark, sf_dir, "pages")))


#: Lengths of the keys planted for op5, and the share of them that must be found.
KEY_LENGTHS, RECALL = (24, 32, 43), 0.9


def contract_op5_planted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op5's battery on documents with a random base64 key each: by length, whether enough are found exactly, and little else."""
    length = F.get(F.array(*map(F.lit, KEY_LENGTHS)), F.pmod("doc_id", F.lit(len(KEY_LENGTHS))).cast("int"))
    digest = F.unhex(F.sha2(F.concat(F.lit("key-"), F.col("doc_id").cast("string")).cast("binary"), 256))
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), length.alias("key_length"))
    docs = docs.withColumn("begin", F.length("text") + 4)
    keyed = docs.withColumn("text", F.concat("text", F.lit(" zz "), F.substring(F.base64(digest), F.lit(1), F.col("key_length")), F.lit(" zz")))
    found = secret_scan.find_secrets(keyed, ["doc_id", "begin", "key_length"])
    random = F.filter("spans", lambda x: x["kind"] == "random")
    here = F.exists(random, lambda x: (x["start"] == F.col("begin")) & (x["end"] == F.col("begin") + F.col("key_length")))
    each = found.select("key_length", here.alias("hit"), (F.size(random) - here.cast("int")).alias("others"))
    share = lambda c: F.sum(F.col(c).cast("int")) / F.count("*")
    return each.groupBy("key_length").agg(
        F.count("*").alias("n"), (share("hit") >= RECALL).alias("enough_found"), (share("others") <= 0.02).alias("little_else")
    )


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_language_id": op1_language_id,
        "op2_token_counts": op2_token_counts,
        "op3_url_filters": op3_url_filters,
        "op4_mixing": op4_mixing,
        "op5_secret_scan": op5_secret_scan,
        "op6_decontaminate": op6_decontaminate,
        "op7_quality_rules": op7_quality_rules,
        "op8_prob_minhash": op8_prob_minhash,
        "op9_cdc_dedup": op9_cdc_dedup,
        "op10_suffix_array": op10_suffix_array,
        "op11_bpe": op11_bpe,
        "op12_source_divergence": op12_source_divergence,
        "op13_phrases": op13_phrases,
        "contract_op4_targets": contract_op4_targets,
        "contract_op3_redirects": contract_op3_redirects,
        "contract_op5_base": contract_op5_base,
        "contract_op5_planted": contract_op5_planted,
        "contract_op7_base": contract_op7_base,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op3_url_filters": url_filters.ORACLE,
        "op6_decontaminate": decontaminate.ORACLE,
        "op12_source_divergence": divergence.ORACLE,
        "op13_phrases": phrases.ORACLE,
        "contract_op4_targets": mixing.ORACLE_TARGETS,
        "contract_op3_redirects": url_filters.ORACLE.replace("FROM pages", "FROM planted").replace("urls AS (", SQL_REDIRECTED, 1),
        "contract_op5_base": secret_scan.ORACLE_BASE,
        "contract_op5_planted": f"""SELECT {list(KEY_LENGTHS)}[doc_id % {len(KEY_LENGTHS)} + 1] AS key_length, count(*) AS n,
  true AS enough_found, true AS little_else FROM documents GROUP BY ALL""",
        "contract_op7_base": quality_rules.ORACLE_BASE,
    }
