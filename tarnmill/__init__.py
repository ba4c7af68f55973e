"""tarnmill: a PySpark-native analytics engine for label mining, evaluation and text corpora.

Every operator is a function ``DataFrame -> DataFrame`` that declares a plan and runs no action of its own
unless its docstring says so.
"""
