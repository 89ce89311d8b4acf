"""Card lists, catalogue, proofing and image-corpus analytics as PySpark jobs."""

__version__ = "0.1.0"
