"""Footfall: web analytics on Spark.

Raw tracking hits go in; activity blocks, stitched identities, attributed
sessions, client and user roll-ups, parsed e-commerce events and reports come
out.  Everything is a function from DataFrames (or Columns) to DataFrames (or
Columns).
"""

from footfall.config import Config, Metric, Rule

__all__ = ["Config", "Metric", "Rule"]
