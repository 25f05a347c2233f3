"""corpusmill: Spark-native operators for preparing, versioning, searching and scoring text corpora."""
