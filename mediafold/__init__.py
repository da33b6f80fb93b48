"""mediafold: media catalog analytics as plain Spark DataFrame jobs.

Every public function takes and returns DataFrames (or Columns) built from
native Spark SQL expressions, joins, windows and aggregations, so Catalyst
plans them and Tungsten runs them.  See README.md for the module map.
"""

from mediafold.session import build_session, checkpoint_dir

__all__ = ["build_session", "checkpoint_dir"]
