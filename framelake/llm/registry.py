"""The registered queries of this subpackage and their SQL."""

from framelake.llm import (
    bpe,
    collocations,
    content_sort,
    decontamination,
    language_id,
    licenses,
    ngram_join,
    permutation_index,
    prefix_trie,
    sharding,
    suffix_tree,
    toxicity,
    url_filter,
)

QUERIES = {
    "op1_byte_bpe": bpe.op1_byte_bpe,
    "op2_permutation_index": permutation_index.op2_permutation_index,
    "op3_ngram_jaccard": ngram_join.op3_ngram_jaccard,
    "op4_toxic_spans": toxicity.op4_toxic_spans,
    "op5_license_scan": licenses.op5_license_scan,
    "op6_hash_tree_shards": sharding.op6_hash_tree_shards,
    "op7_positional_index": decontamination.op7_positional_index,
    "op8_context_tree_language": language_id.op8_context_tree_language,
    "op9_suffix_tree_lm": suffix_tree.op9_suffix_tree_lm,
    "op10_url_filter": url_filter.op10_url_filter,
    "op11_prefix_trie": prefix_trie.op11_prefix_trie,
    "op12_content_sort": content_sort.op12_content_sort,
    "op13_collocations": collocations.op13_collocations,
}

ORACLES = {
    "op3_ngram_jaccard": ngram_join.ORACLE_SQL,
    "op6_hash_tree_shards": sharding.ORACLE_SQL,
    "op7_positional_index": decontamination.ORACLE_SQL,
    "op10_url_filter": url_filter.ORACLE_SQL,
    "op11_prefix_trie": prefix_trie.ORACLE_SQL,
    "op12_content_sort": content_sort.ORACLE_SQL,
    "op13_collocations": collocations.ORACLE_SQL,
}
