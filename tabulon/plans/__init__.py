"""Plans built from operators: named-step runners, question queries and the
registry of queries with their SQL oracles."""
