"""Market analytics on panel data, written as Spark DataFrame plans."""
