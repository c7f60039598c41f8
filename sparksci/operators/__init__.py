"""Operators: DataFrame in, DataFrame out, each over any number of groups at once."""
