"""quillstone: a Spark-native document retrieval and training-data engine."""
