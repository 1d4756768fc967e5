"""Sources, sinks and catalog: relations, schema, ad-hoc SQL, saved views,
ingest (CSV/TSV, JSON/NDJSON, Parquet, inline VALUES), export and snapshots."""
