"""Operators for large training-text pipelines; nothing else in the library imports this subpackage.

Every operator takes a table with at least `doc_id` and `text`, ignores what other columns it may hold, and names in its docstring
what nulls, empty texts, ties and repeated rows give. `queries` registers one query per operator.
"""
