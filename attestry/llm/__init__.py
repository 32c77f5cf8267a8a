"""Operators of a training-data pipeline: one module for each operator, its registered queries in ``queries``."""
