"""Tessera: an analytics engine built on PySpark's DataFrame, SQL and Structured Streaming APIs."""
