"""Relational and spatial operators, each a function from DataFrame to DataFrame."""
