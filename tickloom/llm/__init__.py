"""Operations on training corpora: one module per operation, each a set of functions on DataFrames.

Nothing outside this folder imports it; ``queries`` binds the operations to the document tables.
"""
