"""Training-data operators: ten dealt methods, their queries and SQL."""
