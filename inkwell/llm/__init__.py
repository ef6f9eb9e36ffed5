"""Operators for preparing large text collections as training data.

Nothing outside this folder imports it.  Each module holds one operator with a
general interface; ``queries`` binds the operators to the ``documents``,
``pages`` and ``benchmark`` tables.
"""
