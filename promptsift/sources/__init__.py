"""Readers and writers: texts, tool payloads, synthetic fixtures, the deferred store."""
