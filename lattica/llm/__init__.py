"""Operators for preparing training data at scale.

One module per operator; `queries` holds the thin registered queries and their
oracle SQL. Nothing else in the library imports this subpackage.
"""
