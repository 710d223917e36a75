"""Readers, file-name classification and sinks."""
