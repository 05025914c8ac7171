"""Sources and sinks: raw CSV ingest, the clean Parquet table, JSON
artifacts (contract, validation result, evaluation report, run metadata),
Spark ML model persistence and the run-history scan."""
