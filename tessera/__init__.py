"""Tessera: documents, chunks, relations and retrieval as Spark DataFrames."""
