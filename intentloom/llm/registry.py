"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from intentloom.llm import hmm, langid, licences, merkle, mixing, neardup, packing, quality, simhash, substring, topk, toxicity, vectorcodes


def queries() -> dict:
    return {
        "op1_mixing": mixing.op1_mixing,
        "op2_langid": langid.op2_langid,
        "op3_packing": packing.op3_packing,
        "op4_hmm": hmm.op4_hmm,
        "op5_neardup": neardup.op5_neardup,
        "op6_topk": topk.op6_topk,
        "op7_substring": substring.op7_substring,
        "op8_quality": quality.op8_quality,
        "op9_simhash": simhash.op9_simhash,
        "op10_licences": licences.op10_licences,
        "op11_merkle": merkle.op11_merkle,
        "op12_vectorcodes": vectorcodes.op12_vectorcodes,
        "op13_toxicity": toxicity.op13_toxicity,
    }


def oracle_sql() -> dict[str, str]:
    return {"op6_topk": topk.OP6_SQL, "op10_licences": licences.op10_sql(), "op11_merkle": merkle.op11_sql(), "op12_vectorcodes": vectorcodes.op12_sql()}
