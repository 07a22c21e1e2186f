"""Sources and sinks: Parquet/JSON scans, JSON/Parquet/text sinks, fixture views."""
