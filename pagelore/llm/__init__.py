"""Operators for preparing training data: each module has one of them, ``queries`` registers them."""
