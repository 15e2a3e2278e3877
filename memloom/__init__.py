"""Conversational-memory analytics on Spark: tables in, tables out."""
