"""Scans and sinks: text logs, event messages, lake tables, reports."""
