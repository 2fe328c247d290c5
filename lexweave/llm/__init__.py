"""Operators that prepare training text: one module per operator, its query beside it in ``registry``."""
