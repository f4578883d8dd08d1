"""The queries of the corpus operators, by name, each over its whole table, and the SQL where there is one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from assayline.llm import ann, bpe, chat, decontaminate, lexical, linededup, negatives, repeats, simhash, smallworld, tokenfile, toxicity, urlfilter
from assayline.llm.common import shared_folder, table


def _op2(spark: SparkSession, root: str) -> DataFrame:
    import public_tokenizers

    return bpe.bpe_query(table(spark, root, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def _op10(spark: SparkSession, root: str) -> DataFrame:
    import public_tokenizers

    return tokenfile.token_file_query(table(spark, root, "documents"), shared_folder(spark), public_tokenizers.path("byte_bpe_50k.json"))


QUERIES = {
    "op1_chat_format": lambda spark, root: chat.chat_query(table(spark, root, "conversations")),
    "op2_byte_bpe": _op2,
    "op3_simhash": lambda spark, root: simhash.simhash_query(table(spark, root, "documents")),
    "op4_cross_polytope": lambda spark, root: ann.ann_query(table(spark, root, "embeddings")),
    "op5_decontamination": lambda spark, root: decontaminate.find_contamination(table(spark, root, "documents"), table(spark, root, "benchmark")),
    "op6_repeated_bytes": lambda spark, root: repeats.repeats_query(table(spark, root, "documents")),
    "op7_toxicity": lambda spark, root: toxicity.toxicity_query(table(spark, root, "documents"), table(spark, root, "labels")),
    "op8_line_dedup": lambda spark, root: linededup.line_dedup_query(table(spark, root, "documents")),
    "op9_url_filter": lambda spark, root: urlfilter.filter_urls(table(spark, root, "pages"), table(spark, root, "labels")),
    "op10_token_file": _op10,
    "op11_hard_negatives": lambda spark, root: negatives.negatives_query(table(spark, root, "embeddings")),
    "op12_small_world": lambda spark, root: smallworld.smallworld_query(table(spark, root, "embeddings")),
    "op13_lexical_search": lambda spark, root: lexical.lexical_query(table(spark, root, "documents"), table(spark, root, "benchmark")),
}
ORACLES = {
    "op8_line_dedup": linededup.ORACLE,
    "op9_url_filter": urlfilter.ORACLE,
    "op11_hard_negatives": negatives.ORACLE,
    "op12_small_world": smallworld.ORACLE,
    "op13_lexical_search": lexical.ORACLE,
}
