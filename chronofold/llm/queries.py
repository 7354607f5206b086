"""Queries of the pipeline operators and the SQL that gives the same rows, where SQL can."""

from __future__ import annotations

from . import centroids, decontaminate, fill_middle, license_scan, mixing, near_dedup, quality_rank, quality_rules, secret_scan, sharding, surrogates, url_filter, warc

QUERIES = {
    "op1_benchmark_decontamination": decontaminate.op1,
    "op2_warc_revisits": warc.op2,
    "op3_minhash_near_dedup": near_dedup.op3,
    "op4_quality_ranking": quality_rank.op4,
    "op5_pii_surrogates": surrogates.op5,
    "op6_quality_rules": quality_rules.op6,
    "op7_ring_sharding": sharding.op7,
    "op8_source_mixing": mixing.op8,
    "op9_secret_scan": secret_scan.op9,
    "op10_url_filter": url_filter.op10,
    "op11_license_scan": license_scan.op11,
    "op12_centroid_clustering": centroids.op12,
    "op13_fill_in_middle": fill_middle.op13,
}
ORACLE = {
    "op1_benchmark_decontamination": decontaminate.ORACLE,
    "op2_warc_revisits": warc.ORACLE,
    "op8_source_mixing": mixing.ORACLE,
    "op11_license_scan": license_scan.ORACLE,
    "op12_centroid_clustering": centroids.ORACLE,
    "op13_fill_in_middle": fill_middle.ORACLE,
}
