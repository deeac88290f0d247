"""Spark-first analytics over append-only run trails and the work queues around them."""
