"""Inputs: tables, and adapters from tables to series, points, graphs and images."""
