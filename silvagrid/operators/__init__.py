"""Relational and block-kernel operators over DataFrames."""
