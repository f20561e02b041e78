"""Operators for training-data pipelines (decontamination, toxicity, language-model
scores, token counts, quality rules, near-duplicate joins, personal data, secrets,
sharding, packing).  Nothing outside this subpackage imports it."""
