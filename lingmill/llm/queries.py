"""The pipeline operators' queries and their SQL."""

from __future__ import annotations

from . import bpe, chat, exact_dedup, fim, html_extract, jaccard_join, licenses, mixing, packing, pii, quality_classifier, quality_rules, repair


def pipeline(spark, sf_dir):
    """All stages of corpus_pipeline.py, which stands beside this package."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "op1_packing": packing.op1_packing,
    "op2_chat": chat.op2_chat,
    "op3_html_extract": html_extract.op3_html_extract,
    "op4_mixing": mixing.op4_mixing,
    "op5_licenses": licenses.op5_licenses,
    "op6_exact_dedup": exact_dedup.op6_exact_dedup,
    "op7_quality_classifier": quality_classifier.op7_quality_classifier,
    "op8_pii": pii.op8_pii,
    "op9_jaccard_join": jaccard_join.op9_jaccard_join,
    "op10_quality_rules": quality_rules.op10_quality_rules,
    "op11_fim": fim.op11_fim,
    "op12_repair": repair.op12_repair,
    "op13_bpe": bpe.op13_bpe,
    "pipeline": pipeline,
}

SQL = {
    "op2_chat": chat.SQL,
    "op4_mixing": mixing.SQL,
    "op6_exact_dedup": exact_dedup.SQL,
    "op9_jaccard_join": jaccard_join.SQL,
    "op10_quality_rules": quality_rules.SQL,
    "op11_fim": fim.SQL,
    "op12_repair": repair.SQL,
}
