"""Larkspur: curation, validation, publication and vector retrieval of short text records on PySpark."""
