"""groundstone: a Spark-first engine for grounded facts.

Pages become chunks, chunks become facts tied to a literal span of their page, facts become
comparable quantities, and pairs of facts become relationships.  Everything is a function from
DataFrames to a DataFrame; see README.md for the map of modules.
"""

__version__ = "0.1.0"
