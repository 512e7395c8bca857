"""Queries of the corpus operators and their SQL oracles."""

from __future__ import annotations

from labelq.llm import decontam, langid, lines, media, mixing, quality, secrets, simhash, substrings, urls


def compact(query):
    """Digests are far smaller than the texts they come from: the result is gathered into
    few partitions, not one small file for each task that read texts."""
    return lambda spark, sf_dir: query(spark, sf_dir).hint("rebalance")


QUERIES = {f.__name__: compact(f) for f in (
    lines.op1_line_dedup, decontam.op2_decontamination, langid.op3_language_id, secrets.op4_secret_scan, simhash.op5_simhash,
    quality.op6_quality, mixing.op7_source_mix, urls.op8_url_filter, media.op9_media_columns, substrings.op10_substring_dedup)}

ORACLES = {"op10_substring_dedup": substrings.ORACLE, "op4_secret_scan": secrets.ORACLE, "op7_source_mix": mixing.ORACLE, "op8_url_filter": urls.ORACLE}
