"""The queries of this folder and, where SQL can express them, their SQL."""

from __future__ import annotations

from . import chat, decontam, dedup, langid, mixing, nearjoin, pii, rindex, secrets, tokens



def pipeline(spark, sf_dir):
    import corpus_pipeline  # beside the package, at the top of the repository

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "pipeline": pipeline,
    "op1_source_mix": mixing.op1_source_mix,
    "op2_chat_format": chat.op2_chat_format,
    "op3_exact_dedup": dedup.op3_exact_dedup,
    "op4_decontamination": decontam.op4_decontamination,
    "op5_secret_scan": secrets.op5_secret_scan,
    "op6_substring_dedup": rindex.op6_substring_dedup,
    "op7_language_id": langid.op7_language_id,
    "op8_near_join": nearjoin.op8_near_join,
    "op9_token_output": tokens.op9_token_output,
    "op10_personal_data": pii.op10_personal_data,
}

ORACLE_SQL = {
    "op1_source_mix": mixing.OP1_SQL,
    "op2_chat_format": chat.OP2_SQL,
    "op3_exact_dedup": dedup.OP3_SQL,
}
