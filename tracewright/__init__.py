"""Performance-recording analytics on Spark DataFrames.

Every canonical table carries a leading ``trace_id`` so one job handles any number of recordings.
"""
