"""Operators of a training-data pipeline over documents, embeddings, benchmark items and conversations.

Each operator is a module with functions from DataFrames to a DataFrame; ``queries`` registers one query per operator.
Nothing outside this subpackage imports it.
"""
