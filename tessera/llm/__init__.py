"""Operators that prepare training data: one module per problem, each with its queries and SQL."""
