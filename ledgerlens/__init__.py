"""Company risk monitoring as set-at-a-time PySpark plans.

Every public function takes DataFrames (or Columns) and returns DataFrames (or
Columns) over all companies and filings at once; nothing here runs an action
unless its name says so (`write_*`, `run_*`).
"""
