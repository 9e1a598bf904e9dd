"""A Spark-first engine for streams of timestamped moments."""
