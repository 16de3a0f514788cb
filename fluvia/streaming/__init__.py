"""Keyed operators on streams: the same state machines as in batch, kept in Spark's state store."""
