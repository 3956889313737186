"""Operators for preparing training text at scale.

Nothing else in the package imports this subpackage. Each module holds one operator with a
general interface; :mod:`tessera.llm.queries` holds the thin contract queries over them.
"""
