"""tallyspark: metrics, claims and verdicts as Spark plans."""
