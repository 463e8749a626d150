"""volforge — return-series pricing and accuracy analytics as lazy Spark DataFrame operators.

Every public operator takes DataFrames (or a SparkSession plus a table directory) and returns a
DataFrame; nothing is collected to the driver. Sub-packages:

- ``sources``   table loading, the derived fixture views (prices, quotes, job log), readers and sinks
- ``functions`` Column-level helpers (normal CDF, business days, deterministic random streams, validation)
- ``operators`` the relational and numerical operators (returns, chains, statistics, resampling, pricing,
                evaluation, results, job log)
- ``plans``     end-to-end query plans registered for the driver, with their SQL oracles
- ``streaming`` Structured Streaming jobs (incremental price upsert, job-state folding)
"""

__version__ = "0.1.0"
