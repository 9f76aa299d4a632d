"""Column expressions: conditionals, null rules, dates and the normal quantile."""
