"""linkweave — link-graph analytics as Spark jobs.

Every public operator takes DataFrames and returns DataFrames; the work runs on
the executors.  Sub-packages:

* ``sources``   – schemas, table readers, fixture binding, snapshots, export sinks
* ``functions`` – column expressions (URL/title handling, hashing, vectors)
* ``operators`` – joins, lookups, validation, maintenance, traversals, similarity
* ``plans``     – named queries over a data directory and their SQL oracles
* ``streaming`` – Structured Streaming refresh / change / export jobs
"""

from linkweave.session import checkpoint_dir, get_spark

__all__ = ["checkpoint_dir", "get_spark"]
