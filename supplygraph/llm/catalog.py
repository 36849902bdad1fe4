"""The registered queries of this subpackage and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from supplygraph.llm import align, bpe, common, decontaminate, html, lines, near, quality, secrets, substrings, token_counts, token_files, urls, vectors

Query = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, Query] = {
    "op1_substrings": substrings.op1_substrings,
    "op2_lines": lines.op2_lines,
    "op3_bpe": bpe.op3_bpe,
    "op6_decontaminate": decontaminate.op6_decontaminate,
    "op7_quality": quality.op7_quality,
    "op4_secrets": secrets.op4_secrets,
    "op5_token_files": token_files.op5_token_files,
    "op8_near_duplicates": near.op8_near_duplicates,
    "op9_html": html.op9_html,
    "op10_url_lists": urls.op10_url_lists,
    "op11_token_counts": token_counts.op11_token_counts,
    "op12_vector_codes": vectors.op12_vector_codes,
    "op13_alignment": align.op13_alignment,
}
ORACLES: dict[str, str] = {
    "op1_substrings": substrings.OP1_SQL,
    "op6_decontaminate": decontaminate.OP6_SQL,
    "op10_url_lists": urls.OP10_SQL,
    "op12_vector_codes": vectors.OP12_SQL,
}


def shipped(query: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        common.ship(spark)
        return query(spark, sf_dir)

    return run


QUERIES: dict[str, Query] = {name: shipped(query) for name, query in _QUERIES.items()}
