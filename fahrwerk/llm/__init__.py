"""Operators for preparing language-model training data at scale.

Nothing outside this subpackage imports it.  ``registry`` lists the
queries; each operator module holds one operator with its own interface.
"""
