"""Operators over procurement tables: DataFrames in, one lazy DataFrame out."""
