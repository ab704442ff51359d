"""Operators for preparing large training corpora, each one a Spark job.

Nothing else in the library imports this subpackage; it can be removed whole.
"""
