"""Sheaf: corpus-hygiene analytics as Spark DataFrame plans."""
