"""Registered queries of the training-data operators and their DuckDB twins."""

from __future__ import annotations

from feedloom.llm import (decontam, filter_audit, langid, line_dedup, lm_score, merkle, minhash_forest, mixing, page_templates, pii,
                          quality, rp_forest, url_templates)
from feedloom.llm.common import read


def op1_winnowing(spark, sf_dir):
    return decontam.query(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op2_stupid_backoff(spark, sf_dir):
    return lm_score.query(read(spark, sf_dir, "documents"))


def op3_projection_forest(spark, sf_dir):
    return rp_forest.query(read(spark, sf_dir, "embeddings"))


def op4_site_templates(spark, sf_dir):
    return page_templates.query(read(spark, sf_dir, "pages"))


def op5_pareto_mix(spark, sf_dir):
    return mixing.query(read(spark, sf_dir, "documents"))


def op6_bootstrapped_pii(spark, sf_dir):
    return pii.query(read(spark, sf_dir, "documents"))


def op7_subword_language(spark, sf_dir):
    return langid.query(read(spark, sf_dir, "documents"))


def op8_minhash_forest(spark, sf_dir):
    return minhash_forest.query(read(spark, sf_dir, "documents"))


def op9_line_windows(spark, sf_dir):
    return line_dedup.query(read(spark, sf_dir, "documents"))


def op10_url_templates(spark, sf_dir):
    return url_templates.query(read(spark, sf_dir, "pages"))


def op11_filter_audit(spark, sf_dir):
    return filter_audit.query(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op12_random_indexing_quality(spark, sf_dir):
    return quality.query(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op13_merkle_manifest(spark, sf_dir):
    return merkle.query(read(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_winnowing, op2_stupid_backoff, op3_projection_forest, op4_site_templates, op5_pareto_mix, op6_bootstrapped_pii, op7_subword_language, op8_minhash_forest,
                                  op9_line_windows, op10_url_templates, op11_filter_audit, op12_random_indexing_quality, op13_merkle_manifest)}

SQL = {"op1_winnowing": decontam.SQL, "op2_stupid_backoff": lm_score.SQL,
       "op3_projection_forest": rp_forest.SQL,
       "op5_pareto_mix": mixing.SQL, "op9_line_windows": line_dedup.SQL,
       "op10_url_templates": url_templates.SQL, "op11_filter_audit": filter_audit.SQL,
       "op13_merkle_manifest": merkle.SQL}
