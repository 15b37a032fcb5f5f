"""Operators for preparing training text at cluster scale.

Nothing outside this subpackage imports it; ``queries`` registers one
production query for each operator.
"""
