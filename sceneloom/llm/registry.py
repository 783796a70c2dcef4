"""The queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from sceneloom.llm import exact_dedup, line_dedup, minhash, ngram_join, packing, prefix_trie, repeats, unit_dedup
from sceneloom.llm.bpe import op6_bpe
from sceneloom.llm.exact_dedup import op2_exact_dedup
from sceneloom.llm.fingerprints import op9_syncmer_fingerprints
from sceneloom.llm.language import op3_language_id
from sceneloom.llm.line_dedup import op7_line_dedup
from sceneloom.llm.minhash import op13_minhash_near_dedup
from sceneloom.llm.ngram_join import op1_ngram_jaccard_join
from sceneloom.llm.packing import op5_packing
from sceneloom.llm.prefix_trie import op12_conversation_trie
from sceneloom.llm.quality import op10_quality_gam
from sceneloom.llm.repeats import op4_suffix_array_dedup
from sceneloom.llm.unit_dedup import op8_substring_dedup
from sceneloom.llm.whitening import op11_embedding_whitening

QUERIES = {
    f.__name__: f
    for f in (
        op1_ngram_jaccard_join, op2_exact_dedup, op3_language_id, op4_suffix_array_dedup, op5_packing,
        op6_bpe, op7_line_dedup, op8_substring_dedup, op9_syncmer_fingerprints, op10_quality_gam,
        op11_embedding_whitening, op12_conversation_trie, op13_minhash_near_dedup,
    )
}
ORACLES: dict[str, str] = {"op1_ngram_jaccard_join": ngram_join.SQL, "op2_exact_dedup": exact_dedup.SQL, "op4_suffix_array_dedup": repeats.SQL, "op5_packing": packing.SQL, "op7_line_dedup": line_dedup.SQL, "op8_substring_dedup": unit_dedup.SQL, "op12_conversation_trie": prefix_trie.SQL, "op13_minhash_near_dedup": minhash.SQL}
