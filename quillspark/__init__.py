"""Document-intelligence operators as Spark DataFrame transformations."""
