"""Readers and writers, and the plug-in points for formats that need external software."""
