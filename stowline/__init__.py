"""Object-catalog, record-path, transfer-plan, run-metric and fleet operators on Spark DataFrames."""
