"""Operators for large text corpora, each a function over DataFrames.

Rules that hold for all of them: null text counts as empty text; an input column
named like a result column gives way to the result; a row that occurs twice gives
two result rows unless the operator says otherwise; an empty table gives an empty
result of the same schema.
"""
