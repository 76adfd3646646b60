"""gaugeloom: Spark-native analytics over language-model and agent output."""
