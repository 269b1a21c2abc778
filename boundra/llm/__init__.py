"""Operators for preparing training text: ten corpus operators and their driver queries."""
