"""Web-site reachability and page analytics, declared on Spark DataFrames."""
