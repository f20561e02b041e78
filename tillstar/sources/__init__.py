"""Sources and sinks: driver parquet tables, warehouse CSV files, parquet star store."""
