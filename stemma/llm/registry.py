"""The queries of this subpackage and the SQL of those that SQL can express."""

from . import ann, exact_dedup, language_id, main_text, mixing, packing, prefix_trie, simhash, spelling, token_counts, toxicity, url_filter, warc

QUERIES = {
    "op1_exact_dedup": exact_dedup.op1_exact_dedup,
    "op2_ann": ann.op2_ann,
    "op3_language_id": language_id.op3_language_id,
    "op4_packing": packing.op4_packing,
    "op5_token_counts": token_counts.op5_token_counts,
    "op6_warc": warc.op6_warc,
    "op7_mixing": mixing.op7_mixing,
    "op8_toxicity": toxicity.op8_toxicity,
    "op9_simhash": simhash.op9_simhash,
    "op10_url_filters": url_filter.op10_url_filters,
    "op11_main_text": main_text.op11_main_text,
    "op12_spelling": spelling.op12_spelling,
    "op13_prefix_trie": prefix_trie.op13_prefix_trie,
}

SQL = {
    "op1_exact_dedup": exact_dedup.OP1_SQL,
    "op6_warc": warc.OP6_SQL,
    "op7_mixing": mixing.OP7_SQL,
    "op10_url_filters": url_filter.OP10_SQL,
}
