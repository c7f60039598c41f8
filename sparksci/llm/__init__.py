"""Operators for large training-data pipelines.

Each module holds one operator with a general interface, and the thin query
``opN_<name>`` that applies it to a whole table.  Nothing else in the library
imports this subpackage.
"""
