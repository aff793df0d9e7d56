"""Streaming: the reference has no stream, window, watermark or state; nothing is built here."""
