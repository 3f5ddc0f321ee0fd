"""The registered queries of the training-data operators. ORACLE_SQL has those that SQL can express on whole tables."""

from __future__ import annotations

from . import decontaminate, fertility, kdtree, langid, materialise, packing, phrases, signatures, simhash, sql, suffixes, tries, weaklabel, whitening

QUERIES = {
    "op1_suffix_array": suffixes.op1_suffix_array,
    "op2_language": langid.op2_language,
    "op3_phrases": phrases.op3_phrases,
    "op4_fertility": fertility.op4_fertility,
    "op5_training_order": materialise.op5_training_order,
    "op6_kd_tree": kdtree.op6_kd_tree,
    "op7_simhash": simhash.op7_simhash,
    "op8_decontamination": decontaminate.op8_decontamination,
    "op9_packing": packing.op9_packing,
    "op10_weak_label": weaklabel.op10_weak_label,
    "op11_signature_trees": signatures.op11_signature_trees,
    "op12_whitening": whitening.op12_whitening,
    "op13_prefix_trie": tries.op13_prefix_trie,
}

ORACLE_SQL: dict[str, str] = {
    "op1_suffix_array": sql.REPEATED_BYTES,
    "op3_phrases": sql.REPEATED_WORDS,
    "op11_signature_trees": sql.SIMILAR_SETS,
    "op13_prefix_trie": sql.PREFIX_TRIE,
}
