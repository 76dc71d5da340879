"""lumora: a Spark-first analytics engine for creator data and training-data preparation."""
