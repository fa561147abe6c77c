"""Operators of a training-data pipeline, each a DataFrame-to-DataFrame transform that Spark partitions and shuffles."""
