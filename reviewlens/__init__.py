"""Review analytics on Spark: DataFrame operators for aspect-based sentiment.

``functions``  Column -> Column expressions (text, labels, URLs, payload fields)
``operators``  DataFrame -> DataFrame operators (rules, dedup, metrics, ...)
``sources``    readers and writers, including a workbook data source
``streaming``  Structured Streaming forms of the same operators
``plans``      session helper, table views and the catalogue of named queries
"""

__version__ = "0.1.0"
