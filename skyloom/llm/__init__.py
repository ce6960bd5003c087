"""Operations of a training-data pipeline over a table of documents."""

from . import alignment, conversations, decontam, exact_dedup, langid, licenses, packing, ppm, quality, repeats, sharding, simhash, toxicity


def queries():
    return {
        "op1_exact_dedup": exact_dedup.query,
        "op2_simhash": simhash.query,
        "op3_licenses": licenses.query,
        "op4_toxicity": toxicity.query,
        "op5_quality": quality.query,
        "op6_repeats": repeats.query,
        "op7_decontam": decontam.query,
        "op8_packing": packing.query,
        "op9_langid": langid.query,
        "op10_lm_score": ppm.query,
        "op11_token_alignment": alignment.query,
        "op12_shuffled_shards": sharding.query,
        "op13_conversation_repair": conversations.query,
    }


def oracle_sql():
    return {"op1_exact_dedup": exact_dedup.ORACLE}
