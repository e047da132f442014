"""Operators for preparing training data at corpus scale.

Nothing else in the library imports this subpackage. Each module holds one
operator with a general interface; ``queries`` registers the contract queries
that apply them to whole tables.
"""
