"""Data work around machine-learning models, written as Spark jobs."""
