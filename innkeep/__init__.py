"""innkeep: stay / booking analytics on Spark DataFrames.

Every operator takes DataFrames (usually a dict ``T`` of domain tables)
and returns DataFrames; nothing is collected except bounded helper
values (range bounds, per-bucket counts, round counts).
"""

DEFAULT_AS_OF = "1998-06-15"
