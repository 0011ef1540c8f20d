"""Sinks: artifacts by content, files of documents."""
