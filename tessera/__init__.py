"""tessera: a Spark-native corpus index.

Text is tiled into byte-exact token spans, nested scopes are recovered from
the token stream, declarations and references are extracted and resolved to
their innermost visible declaration, and symbol indexes, diagnostics,
completions and dictionary encodings are derived from that.  Every operator is
a function from DataFrames to a DataFrame; Catalyst plans them and executors
run them.
"""

__version__ = "0.1.0"
