"""The queries opN_<name> of this subpackage: each applies one operator to its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pagelore.llm import decontaminate, fill_in_middle, language, language_model, media, mixing, simhash, substrings, suffix_dedup, token_counts, toxicity, warc, whitening
from pagelore.llm.common import table


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def over(plan: Callable[..., DataFrame], *names: str) -> Callable[[SparkSession, str], DataFrame]:
        return lambda spark, sf_dir: plan(*(table(spark, sf_dir, n) for n in names))

    return {
        "op1_decontaminate": over(decontaminate.op1_decontaminate, "documents", "benchmark"),
        "op2_substrings": over(substrings.op2_substrings, "documents"),
        "op3_toxicity": over(toxicity.op3_toxicity, "documents", "labels"),
        "op4_language_model": over(language_model.op4_language_model, "documents"),
        "op5_media": over(media.op5_media, "documents"),
        "op6_token_counts": over(token_counts.op6_token_counts, "documents"),
        "op7_mixing": over(mixing.op7_mixing, "documents"),
        "op8_suffix_dedup": over(suffix_dedup.op8_suffix_dedup, "documents"),
        "op9_language": over(language.op9_language, "documents"),
        "op10_simhash": over(simhash.op10_simhash, "documents"),
        "op11_whitening": over(whitening.op11_whitening, "embeddings"),
        "op12_warc": over(warc.op12_warc, "pages"),
        "op13_fill_in_middle": over(fill_in_middle.op13_fill_in_middle, "documents"),
    }


def oracle_sql() -> dict[str, str]:
    return {"op7_mixing": mixing.oracle_sql()}
