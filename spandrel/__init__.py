"""Program-analysis tables, graph queries, rule checks, metrics and data quality on Spark DataFrames."""
