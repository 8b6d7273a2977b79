"""Scalar expressions and unit algebra."""
