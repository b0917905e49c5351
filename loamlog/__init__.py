"""loamlog: log and trace analytics on Spark DataFrames."""
