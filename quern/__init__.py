"""quern: PySpark-native text curation, vocabulary, split and metric operators."""
