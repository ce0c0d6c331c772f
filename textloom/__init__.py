"""textloom: analyse and losslessly re-encode large text corpora on Spark."""

__version__ = "0.1.0"
