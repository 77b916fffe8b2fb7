"""The registered queries of this subpackage: name -> (query, SQL or None)."""

from __future__ import annotations

from greenspark.llm import (decontaminate, hard_negatives, html_main, jaccard_join, language, pieces, pii, quality_rules, runs, sharding,
                            suffix_dedup, url_filter, warc_zip)
from greenspark.llm.common import read


def op1_decontamination(spark, sf_dir):
    return decontaminate.leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op2_suffix_dedup(spark, sf_dir):
    return suffix_dedup.repeated_passages(read(spark, sf_dir, "documents"))


def op3_quality_rules(spark, sf_dir):
    return quality_rules.quality_digest(read(spark, sf_dir, "documents"))


def op4_sharding(spark, sf_dir):
    return sharding.sharding_digest(read(spark, sf_dir, "documents"))


def op5_language(spark, sf_dir):
    return language.language_digest(read(spark, sf_dir, "documents"))


def op6_url_filter(spark, sf_dir):
    return url_filter.url_digest(read(spark, sf_dir, "pages"))


def op7_pieces(spark, sf_dir):
    return pieces.encode_documents(read(spark, sf_dir, "documents"))


def op8_pii(spark, sf_dir):
    return pii.pii_digest(read(spark, sf_dir, "documents"))


def op9_html_main(spark, sf_dir):
    return html_main.extract(read(spark, sf_dir, "pages"))


def op10_jaccard_join(spark, sf_dir):
    return jaccard_join.jaccard_digest(read(spark, sf_dir, "documents"))


def op11_warc_zip(spark, sf_dir):
    return warc_zip.warc_digest(read(spark, sf_dir, "pages"))


def op12_runs(spark, sf_dir):
    return runs.runs_digest(read(spark, sf_dir, "documents"))


def op13_hard_negatives(spark, sf_dir):
    return hard_negatives.negatives_digest(read(spark, sf_dir, "embeddings"))


CHECKS = {
    "op1_decontamination": (op1_decontamination, None),
    "op2_suffix_dedup": (op2_suffix_dedup, None),
    "op3_quality_rules": (op3_quality_rules, quality_rules.SQL),
    "op4_sharding": (op4_sharding, None),
    "op5_language": (op5_language, None),
    "op7_pieces": (op7_pieces, None),
    "op8_pii": (op8_pii, None),
    "op9_html_main": (op9_html_main, None),
    "op10_jaccard_join": (op10_jaccard_join, None),
    "op6_url_filter": (op6_url_filter, None),
    "op11_warc_zip": (op11_warc_zip, warc_zip.SQL),
    "op12_runs": (op12_runs, None),
    "op13_hard_negatives": (op13_hard_negatives, hard_negatives.SQL),
}
