"""Training-data operators: one module an operator, and the queries that apply them.

Nothing else in the package imports this subpackage; it can be deleted whole.
"""
