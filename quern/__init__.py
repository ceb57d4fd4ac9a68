"""quern: Spark-native processing of paged document corpora and evaluation logs."""
