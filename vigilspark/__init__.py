"""vigilspark: a Spark-first analytics engine for online-fraud intelligence."""
