"""Operators for preparing training data, one module per operator.

Nothing else in the library imports this subpackage.  ``vantage.llm.queries``
registers one thin query per operator.
"""
