"""quarrylib: structure analytics for large multi-project codebases on Spark."""

__version__ = "0.1.0"
