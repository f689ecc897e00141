"""Analytics over transportation networks built from trip records, on Spark."""
