"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from sourceloom.llm import bpe, chat, collocations, decontaminate, lcp, neardup, packing, pii, ppm, quality, secrets, warczip, whitening

QUERIES = {
    "op1_shape_crf": pii.op1_shape_crf,
    "op2_order_minhash": neardup.op2_order_minhash,
    "op3_zip_packages": warczip.op3_zip_packages,
    "op4_prefix_targets": chat.op4_prefix_targets,
    "op5_secret_ownership": secrets.op5_secret_ownership,
    "op6_ppm_score": ppm.op6_ppm_score,
    "op7_kneser_ney": quality.op7_kneser_ney,
    "op8_bpe_trees": bpe.op8_bpe_trees,
    "op9_benchmark_windows": decontaminate.op9_benchmark_windows,
    "op10_phrase_fingerprints": lcp.op10_phrase_fingerprints,
    "op11_collocation_automata": collocations.op11_collocation_automata,
    "op12_window_packing": packing.op12_window_packing,
    "op13_chebyshev_whitening": whitening.op13_chebyshev_whitening,
}

# The others cannot be told in SQL; tests compare them with brute force.
SQL = {
    "op3_zip_packages": warczip.SQL,
    "op4_prefix_targets": chat.SQL,
    "op9_benchmark_windows": decontaminate.SQL,
    "op11_collocation_automata": collocations.SQL,
}
