"""Eventide: event-evidence analytics expressed as PySpark DataFrame transforms."""
