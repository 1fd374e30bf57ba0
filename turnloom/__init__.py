"""Turnloom: conversation-memory analytics expressed as Spark DataFrame plans."""
