"""Operators of a training-data pipeline, each by one named method.

Nothing outside this subpackage imports it; it imports only the session
helpers (scratch tables under ``spark.checkpoint.dir``) of the library.
"""
