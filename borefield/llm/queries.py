"""The registered queries of the text operators, and SQL where it can express them."""

from . import centroids, decontamination, first_fit, manifest, packing, preference, quality, secrets, simhash, suffixes, token_counts, topk, toxicity

QUERIES = {
    "op1_toxicity": toxicity.op1_toxicity,
    "op2_decontamination": decontamination.op2_decontamination,
    "op3_preference_formatting": preference.op3_preference_formatting,
    "op4_best_fit_packing": packing.op4_best_fit_packing,
    "op5_token_counts": token_counts.op5_token_counts,
    "op6_secret_scans": secrets.op6_secret_scans,
    "op7_quality_classifier": quality.op7_quality_classifier,
    "op8_exact_top_k": topk.op8_exact_top_k,
    "op9_simhash": simhash.op9_simhash,
    "op10_suffix_dedup": suffixes.op10_suffix_dedup,
    "op11_merkle_manifest": manifest.op11_merkle_manifest,
    "op12_centroid_clustering": centroids.op12_centroid_clustering,
    "op13_first_fit_packing": first_fit.op13_first_fit_packing,
}

ORACLE_SQL = {"op3_preference_formatting": preference.SQL, "op8_exact_top_k": topk.SQL, "op11_merkle_manifest": manifest.SQL, "op12_centroid_clustering": centroids.SQL}
