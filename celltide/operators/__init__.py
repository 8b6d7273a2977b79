"""Relational operators: properties, filters, tracking, statistics, registration, provenance."""
