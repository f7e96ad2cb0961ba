"""Continuous maintenance of an index from a stream of notes."""
