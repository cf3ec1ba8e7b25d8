"""Document search and analytics on Spark: columns, relations and streams, all as lazy plans."""
