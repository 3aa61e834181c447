"""Operators on streams. Row-wise operators are stateless and take a streaming column as it is."""
