"""Market-data feature engine on PySpark."""
