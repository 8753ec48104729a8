"""Operators for preparing text for language-model training.

Nothing outside this subpackage imports it. Every operator takes a DataFrame
and the names of the columns it works on, selects only those, and so is
indifferent to further columns.
"""
