"""The queries of this subpackage and their SQL."""

from factloom.llm import bpe, chat, embeddings, html_text, minhash, packing, quality, repair, secrets, sharding, substrings, urls, whitening

QUERIES = {
    "op1_packing": packing.op1_packing,
    "op2_embeddings": embeddings.op2_embeddings,
    "op3_bpe": bpe.op3_bpe,
    "op4_minhash": minhash.op4_minhash,
    "op5_secrets": secrets.op5_secrets,
    "op6_sharding": sharding.op6_sharding,
    "op7_substrings": substrings.op7_substrings,
    "op8_html": html_text.op8_html,
    "op9_quality": quality.op9_quality,
    "op10_urls": urls.op10_urls,
    "op11_repair": repair.op11_repair,
    "op12_chat": chat.op12_chat,
    "op13_whitening": whitening.op13_whitening,
}
ORACLES = {"op2_embeddings": embeddings.SQL, "op9_quality": quality.SQL, "op11_repair": repair.SQL, "op12_chat": chat.SQL}
