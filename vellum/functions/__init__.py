"""Scalar functions as column expressions, and Arrow-backed ones where bytes must be decoded."""
