"""Vector search and payload analytics over parquet tables, as DataFrame and Spark SQL programs."""
