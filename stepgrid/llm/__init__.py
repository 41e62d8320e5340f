"""Training-data operators: ten Spark jobs over text, vector, chat and page tables.

Nothing else in the library imports this subpackage.
"""
