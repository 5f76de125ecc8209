"""Data-quality and corpus analytics as Spark plans."""
