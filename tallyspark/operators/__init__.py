"""Operators over DataFrames; none of them knows the tables it is used on."""
