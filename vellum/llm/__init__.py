"""Operators for building training corpora: ten operators, their queries and oracle SQL."""
