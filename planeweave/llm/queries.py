"""The queries of this folder, by name, and SQL for those that SQL can express."""

from planeweave.llm import chat, licenses, lm, media, mixing, packing, simhash, topk, toxicity, urls

QUERIES = {
    "op1_dual_tree_topk": topk.op1_dual_tree_topk,
    "op2_digest_url_filter": urls.op2_digest_url_filter,
    "op3_prefix_license_scan": licenses.op3_prefix_license_scan,
    "op4_local_descriptor_copies": media.op4_local_descriptor_copies,
    "op5_deletion_variant_simhash": simhash.op5_deletion_variant_simhash,
    "op6_pivotal_mix": mixing.op6_pivotal_mix,
    "op7_cost_balanced_packing": packing.op7_cost_balanced_packing,
    "op8_blockmax_toxicity": toxicity.op8_blockmax_toxicity,
    "op9_fingerprint_chat_format": chat.op9_fingerprint_chat_format,
    "op10_hashed_maxent_lm": lm.op10_hashed_maxent_lm,
}
ORACLES = {"op1_dual_tree_topk": topk.SQL, "op2_digest_url_filter": urls.SQL, "op3_prefix_license_scan": licenses.SQL, "op9_fingerprint_chat_format": chat.SQL}
