"""tablerelay: guarded table relay, incremental sync and run analytics on Spark."""

__version__ = "0.1.0"
