"""Stateful protocols and event-time streams."""
