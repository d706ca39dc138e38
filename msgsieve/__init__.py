"""Message-risk analytics on Spark: prepare, split, train, score and monitor."""

__version__ = "1.0.0"
