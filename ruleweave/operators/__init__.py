"""Operators of the rule and graph engine."""
