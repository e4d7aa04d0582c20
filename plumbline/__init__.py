"""plumbline: data jobs on Spark DataFrames — load, validate, conform, audit,
deduplicate, upsert, reconcile, monitor, measure, profile and segment."""
