"""Point-in-time market, filing and event analytics as PySpark DataFrame operators."""
