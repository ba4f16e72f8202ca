"""Grid-risk analytics as Spark DataFrame plans."""
