"""Market, news, corpus and trace analytics as PySpark table operators.

Every operator is a lazy ``DataFrame -> DataFrame`` function that works for all
keys of a table at once. See the README for the map of operators.
"""
