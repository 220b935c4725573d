"""Scans and sinks: logs, the dataset's files, exports."""
