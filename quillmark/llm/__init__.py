"""Operators that prepare text for training runs. Nothing outside this subpackage imports it."""
