"""archivolt - retrieval and knowledge analytics over an information store, on PySpark."""

__version__ = "0.1.0"
