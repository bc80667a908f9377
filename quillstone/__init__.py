"""quillstone: document retrieval, text processing and data-quality analytics on Spark DataFrames."""

__version__ = "0.1.0"
