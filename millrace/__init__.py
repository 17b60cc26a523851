"""Spark-first preparation and auditing of language-model training corpora.

Every public function takes and returns DataFrames (or Columns) and leaves the
physical strategy to Catalyst; nothing here collects rows to the driver unless
its docstring names the bound.
"""

__version__ = "0.1.0"
