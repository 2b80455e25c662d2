"""quarry: retrieval-evaluation and corpus jobs expressed as Spark DataFrame plans."""

__version__ = "0.1.0"
