"""tidepool: structural decision analytics on Spark DataFrames."""
