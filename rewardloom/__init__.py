"""Spark operators for the data side of language-model post-training."""
