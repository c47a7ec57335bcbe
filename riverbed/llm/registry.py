"""The queries of this subpackage, and their SQL."""

from __future__ import annotations

from riverbed.llm import bpe, decontaminate, license_scan, near_dedup, quality_model, quality_rules, secrets, suffix_dedup, url_filter, warc


def _pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    return {
        "op1_quality_rules": quality_rules.op1_quality_rules,
        "op2_byte_bpe": bpe.op2_byte_bpe,
        "op3_decontaminate": decontaminate.op3_decontaminate,
        "op4_secret_scan": secrets.op4_secret_scan,
        "op5_suffix_dedup": suffix_dedup.op5_suffix_dedup,
        "op6_url_filter": url_filter.op6_url_filter,
        "op7_warc": warc.op7_warc,
        "op8_license_scan": license_scan.op8_license_scan,
        "op9_quality_model": quality_model.op9_quality_model,
        "op10_near_dedup": near_dedup.op10_near_dedup,
        "pipeline": _pipeline,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_quality_rules": quality_rules.SQL, "op3_decontaminate": decontaminate.SQL, "op4_secret_scan": secrets.SQL, "op7_warc": warc.SQL}
