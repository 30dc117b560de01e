"""Queries of the training-data operators, over their whole tables."""

from __future__ import annotations

from . import curriculum, decontaminate, jaccard, line_align, pseudonyms, quality, shards, tiff, token_store, toxicity


def pipeline(spark, sf_dir: str):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    return {
        "op1_tiff_pages": tiff.op1_tiff_pages,
        "op2_ngram_jaccard": jaccard.op2_ngram_jaccard,
        "op3_wu_manber": decontaminate.op3_wu_manber,
        "op4_feistel_pseudonyms": pseudonyms.op4_feistel_pseudonyms,
        "op5_token_store": token_store.op5_token_store,
        "op6_additive_model": quality.op6_additive_model,
        "op7_histogram_sort": shards.op7_histogram_sort,
        "op8_patience_lines": line_align.op8_patience_lines,
        "op9_kneser_ney": toxicity.op9_kneser_ney,
        "op10_curriculum_mix": curriculum.op10_curriculum_mix,
        "pipeline": pipeline,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_ngram_jaccard": jaccard.ORACLE, "op3_wu_manber": decontaminate.ORACLE, "op10_curriculum_mix": curriculum.ORACLE}
