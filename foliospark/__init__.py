"""foliospark: a PySpark-native analytics engine for library-style corpora.

Subpackages
-----------
sources    readers and writers (parquet tables, CSV exports, text blocks, XML, MARC21, SQLite)
functions  column expressions: text, identifiers, dates, JSON, arrays, vectors, scores
operators  DataFrame -> DataFrame operators: filters, joins, aggregates, windows, set operations, writes
plans      composite pipelines and the registry of named queries with their SQL oracles
streaming  Structured Streaming versions of the ingest, rate and progress jobs
llm        optional operators for training-data pipelines; nothing else imports it
"""

__version__ = "0.1.0"
