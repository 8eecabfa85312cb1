"""Behaviour, recommendation and text analytics as Spark DataFrame operators."""
