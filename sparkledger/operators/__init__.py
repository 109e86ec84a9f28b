"""Operators over DataFrames: aggregation, exposure, taxonomy, retrieval, semantic counts, entities, evaluation."""
