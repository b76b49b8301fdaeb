"""textloom: Spark-first operators for preparing and measuring text corpora."""
