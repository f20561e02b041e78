"""The queries of the operators, and their DuckDB twins where SQL can express them."""

from __future__ import annotations

from . import decontamination, jaccard_join, language_model, merkle_manifest, packing, periodic_runs, personal_data, quality_rules, secrets, sharding, simhash_links, token_counts, toxicity

QUERIES = {
    "op3_language_model": language_model.query,
    "op6_jaccard_join": jaccard_join.query,
    "op1_decontamination": decontamination.query,
    "op10_packing": packing.query,
    "op2_toxicity": toxicity.query,
    "op8_secrets": secrets.query,
    "op4_token_counts": token_counts.query,
    "op5_quality_rules": quality_rules.query,
    "op7_personal_data": personal_data.query,
    "op9_sharding": sharding.query,
    "op11_simhash": simhash_links.query,
    "op12_periodic_runs": periodic_runs.query,
    "op13_merkle_manifest": merkle_manifest.query,
}

ORACLE_SQL = {
    "op5_quality_rules": quality_rules.ORACLE_SQL,
    "op9_sharding": sharding.ORACLE_SQL,
    "op13_merkle_manifest": merkle_manifest.ORACLE_SQL,
}
