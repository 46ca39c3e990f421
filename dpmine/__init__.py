"""dpmine: the data work of dense passage retrieval as PySpark DataFrame operators.

Every public function takes and returns DataFrames (or Columns); nothing is
collected to the driver except one-row checks and size-checked broadcast blocks.
"""

__all__ = ["session", "sources", "functions", "operators", "plans", "streaming"]
