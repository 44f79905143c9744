"""Registered queries of the corpus operators, over whole tables with production parameters."""

from __future__ import annotations

from tideline.llm import alignment, bpe, classifier, fingerprints, html_text, merkle, near_dedup, nearest, packing, quality_rules, substrings, token_counts, url_filter
from tideline.llm.common import table


def op7_packing(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"))


def op9_token_counts(spark, sf_dir):
    return token_counts.edited_counts(token_counts.sample_edits(table(spark, sf_dir, "documents")))


def op10_bpe(spark, sf_dir):
    return bpe.digests(table(spark, sf_dir, "documents"))


def op1_substring_dedup(spark, sf_dir):
    return substrings.passages(table(spark, sf_dir, "documents"))


def op2_quality_rules(spark, sf_dir):
    return quality_rules.judged(table(spark, sf_dir, "documents"))


def op3_html_text(spark, sf_dir):
    return html_text.extract(table(spark, sf_dir, "pages"))


def op4_fingerprints(spark, sf_dir):
    return fingerprints.fingerprints(table(spark, sf_dir, "documents"))


def op5_near_dedup(spark, sf_dir):
    return near_dedup.classes(table(spark, sf_dir, "documents"))


def op6_quality_classifier(spark, sf_dir):
    return classifier.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_url_filter(spark, sf_dir):
    return url_filter.judge(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))


def op11_alignment(spark, sf_dir):
    return alignment.align(table(spark, sf_dir, "documents"))


def op12_nearest(spark, sf_dir):
    return nearest.search(table(spark, sf_dir, "embeddings"))


def op13_merkle(spark, sf_dir):
    return merkle.manifest(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_substring_dedup, op2_quality_rules, op3_html_text, op4_fingerprints, op5_near_dedup, op6_quality_classifier, op7_packing, op8_url_filter, op9_token_counts, op10_bpe, op11_alignment, op12_nearest, op13_merkle)}
ORACLE_SQL: dict[str, str] = {"op8_url_filter": url_filter.ORACLE_SQL, "op13_merkle": merkle.ORACLE_SQL}
