"""The queries of this subpackage, and SQL for those that SQL can express."""

from stratum.llm import chat, decontaminate, embeddings, langid, linededup, pieces, pii, simhash, tokencount, urlfilter

QUERIES = {
    "op1_decontaminate": decontaminate.op1_decontaminate,
    "op2_url_filter": urlfilter.op2_url_filter,
    "op3_simhash": simhash.op3_simhash,
    "op4_embedding_dedup": embeddings.op4_embedding_dedup,
    "op5_sentencepiece": pieces.op5_sentencepiece,
    "op6_pii": pii.op6_pii,
    "op7_token_counts": tokencount.op7_token_counts,
    "op8_line_dedup": linededup.op8_line_dedup,
    "op9_chat_format": chat.op9_chat_format,
    "op10_language_id": langid.op10_language_id,
}
ORACLE = {"op1_decontaminate": decontaminate.OP1_SQL, "op2_url_filter": urlfilter.OP2_SQL, "op4_embedding_dedup": embeddings.OP4_SQL, "op9_chat_format": chat.OP9_SQL}
