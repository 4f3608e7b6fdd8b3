"""Sources: directories of Parquet files as tables."""
