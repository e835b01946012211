"""lexloom: Spark-native operators for building, auditing and evaluating text-retrieval datasets."""
