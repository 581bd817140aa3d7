"""phonolake: Spark-native evaluation and analytics of sequence-prediction output."""
