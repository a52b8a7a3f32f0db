"""Relational and stateful operators over DataFrames."""
