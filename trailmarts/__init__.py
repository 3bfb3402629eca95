"""Analytics over coding-agent session logs, written as Spark DataFrame functions.

``sources``    files to raw lines and side tables
``functions``  column expressions and small DataFrame helpers
``operators``  raw lines to typed tables and per-session marts
``plans``      reports across sessions
``streaming``  the same work over Structured Streaming
``catalog``    the registered queries and their SQL twins
"""
