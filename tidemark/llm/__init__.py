"""Operators for preparing language-model training data, and the queries that apply them.

Every operator takes a DataFrame and names of its columns and returns a DataFrame. It reads
only the named columns, so further columns of any name never clash with its own."""
