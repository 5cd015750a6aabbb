"""The subpackage's queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, divergence, exact_dedup, language_id, lexical_search, ngram_join, packing, quality, secrets, token_counts, token_files, url_filter, warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_decontamination": decontaminate.op1_decontamination,
        "op2_secret_scan": secrets.op2_secret_scan,
        "op3_token_counts": token_counts.op3_token_counts,
        "op4_ngram_jaccard_join": ngram_join.op4_ngram_jaccard_join,
        "op4_ngram_jaccard_links": ngram_join.op4_ngram_jaccard_links,
        "op5_quality": quality.op5_quality,
        "op6_url_filter": url_filter.op6_url_filter,
        "op7_exact_dedup": exact_dedup.op7_exact_dedup,
        "op8_language_id": language_id.op8_language_id,
        "op9_curve_packing": packing.op9_curve_packing,
        "op10_token_files": token_files.op10_token_files,
        "op11_lexical_search": lexical_search.op11_lexical_search,
        "op12_source_divergence": divergence.op12_source_divergence,
        "op13_warc": warc.op13_warc,
    }


def oracle_sql() -> dict[str, str]:
    return {"op6_url_filter": url_filter.OP6_SQL, "op7_exact_dedup": exact_dedup.OP7_SQL, "op11_lexical_search": lexical_search.OP11_SQL, "op12_source_divergence": divergence.OP12_SQL, "op13_warc": warc.OP13_SQL}
