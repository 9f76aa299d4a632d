"""Plans built from the operators: the movement table, the wide table, the query registry."""
