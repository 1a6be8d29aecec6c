"""Episodic-evidence analytics expressed as PySpark DataFrame operators."""
