"""A Spark-native analytical SQL engine over directories of Parquet files."""
