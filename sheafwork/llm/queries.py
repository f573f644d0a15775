"""The registered queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from . import collocations, hilbert, hnsw, langid, mixing, ngram_join, one_bit, oracles, packing, periodic, quality, tokens, toxicity, url_tree

ORACLES: dict[str, str] = {"op8_hnsw": oracles.EMBEDDING_LINKS, "op10_ngram_jaccard": oracles.JACCARD_LINKS, "op11_collocations": oracles.COLLOCATIONS}


def queries() -> dict:
    return {
        "op1_length_histogram": tokens.op1_length_histogram,
        "op2_toxicity": toxicity.op2_toxicity,
        "op3_hilbert": hilbert.op3_hilbert,
        "op4_langid": langid.op4_langid,
        "op5_packing": packing.op5_packing,
        "op6_url_tree": url_tree.op6_url_tree,
        "op7_mixing": mixing.op7_mixing,
        "op8_hnsw": hnsw.op8_hnsw,
        "op9_quality": quality.op9_quality,
        "op10_ngram_jaccard": ngram_join.op10_ngram_jaccard,
        "op11_collocations": collocations.op11_collocations,
        "op12_periodic": periodic.op12_periodic,
        "op13_one_bit": one_bit.op13_one_bit,
    }


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
