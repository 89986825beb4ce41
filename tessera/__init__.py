"""tessera — corpus analytics and evaluation as Spark DataFrame jobs.

Every public operator is a function from DataFrames to DataFrames built on
public PySpark APIs (DataFrame / SQL / Structured Streaming / Spark ML).
Sub-packages:

* ``sources``   — readers, writers and landing-zone ingestion
* ``functions`` — column expressions (text, JSON, vectors, traces)
* ``operators`` — joins, aggregates and windows over whole tables
* ``plans``     — adapters from the test tables, the readout, the query registry
* ``streaming`` — incremental ingest with Structured Streaming
"""

__version__ = "0.1.0"
