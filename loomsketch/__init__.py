"""A Spark-native engine for sampled k-mer sketches."""
