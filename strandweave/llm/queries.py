"""The subpackage's queries and, where SQL can express them, their DuckDB equivalents."""

from __future__ import annotations

from strandweave.llm import bytebpe, itq, langid, minhash, mixing, mtree, packing, pagediff, pivots, ring, suffix, tokenstore, vectorcode

QUERIES = {
    "op1_token_store": tokenstore.query,
    "op2_minhash": minhash.query,
    "op3_language_id": langid.query,
    "op4_itq_dedup": itq.query,
    "op5_mtree_search": mtree.query,
    "op6_page_diff": pagediff.query,
    "op7_ring_shards": ring.query,
    "op8_packing": packing.query,
    "op9_suffix_dedup": suffix.query,
    "op10_mixing": mixing.query,
    "op11_byte_bpe": bytebpe.query,
    "op12_vector_code": vectorcode.query,
    "op13_hard_negatives": pivots.query,
}

ORACLES = {
    "op2_minhash": minhash.SQL,
    "op4_itq_dedup": itq.SQL,
    "op5_mtree_search": mtree.SQL,
    "op10_mixing": mixing.SQL,
    "op12_vector_code": vectorcode.SQL,
    "op13_hard_negatives": pivots.SQL,
}
