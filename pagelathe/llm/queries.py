"""The queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

from . import centroids, decontam, licenses, minhash, oracles, passages, periods, pieces, pii, prefixes, quality, secrets, suffixes, topk


def queries() -> dict:
    return {
        "op1_license_scan": licenses.op1_license_scan,
        "op2_exact_topk": topk.op2_exact_topk,
        "op3_sentencepiece": pieces.op3_sentencepiece,
        "op4_quality_resample": quality.op4_quality_resample,
        "op5_minhash_dedup": minhash.op5_minhash_dedup,
        "op6_passage_dedup": passages.op6_passage_dedup,
        "op7_pii_spans": pii.op7_pii_spans,
        "op8_benchmark_decontamination": decontam.op8_benchmark_decontamination,
        "op9_suffix_dedup": suffixes.op9_suffix_dedup,
        "op10_secret_scan": secrets.op10_secret_scan,
        "op11_periodic_runs": periods.op11_periodic_runs,
        "op12_jaccard_join": prefixes.op12_jaccard_join,
        "op13_centroid_clusters": centroids.op13_centroid_clusters,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_license_scan": licenses.oracle(),
        "op2_exact_topk": topk.oracle(),
        "op5_minhash_dedup": oracles.OP5,
        "op6_passage_dedup": oracles.OP6,
        "op9_suffix_dedup": oracles.OP9,
        "op10_secret_scan": oracles.OP10,
        "op11_periodic_runs": periods.oracle(),
        "op12_jaccard_join": oracles.OP12,
        "op13_centroid_clusters": centroids.oracle(),
    }
