"""Training-data operators: thirteen corpus operations and the queries that apply them.

Nothing else in the library imports this subpackage.
"""
