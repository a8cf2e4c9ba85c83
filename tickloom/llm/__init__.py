"""Operators for preparing large text corpora on Spark.

Nothing else in the library imports this subpackage.  ``registry`` lists its queries.
"""
