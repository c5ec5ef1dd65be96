"""lotsman: Spark-native semantic annotation, retrieval evaluation and corpus preparation.

Everything is ``DataFrame -> DataFrame``.  Row order is always an explicit column.
"""
