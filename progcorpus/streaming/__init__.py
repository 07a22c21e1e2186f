"""Structured Streaming entry points.

The reference has no stream processing.  What is here applies the library's
row-local column jobs unchanged to a ``readStream`` of submissions, so a
growing folder of program files can be profiled incrementally.
"""
