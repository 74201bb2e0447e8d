"""Event-time market analytics as Spark DataFrame plans."""
