"""Scans, sinks and stores."""
