"""sparkloom: document analytics expressed as Spark DataFrames and SQL."""
