"""touchline: match analytics on PySpark."""
