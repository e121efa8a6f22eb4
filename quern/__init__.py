"""quern: analytics over bar series, news, text and retrieval data on Spark DataFrames."""
