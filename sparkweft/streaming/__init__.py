"""Streaming counterparts of the chunked reader and the log statistics."""
