"""Tidemark: point-in-time analytics on PySpark.

Every operator takes and returns DataFrames; plans stay declarative so that Catalyst
chooses the physical strategy, and Python workers are used only where no built-in
expression covers the semantics.
"""

__version__ = "0.1.0"
