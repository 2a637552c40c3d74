"""Readers; unreadable input becomes rows with the corrupt text, never a failed job."""
