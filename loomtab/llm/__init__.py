"""Operators for large-scale training-data preparation.

Ten operators over ``documents``, ``pages`` and ``benchmark`` tables, each in a
module of its own, and ``queries`` with their registered forms.  Nothing
outside this subpackage imports it.
"""
