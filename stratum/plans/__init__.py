"""Warehouse plans: specifications, business metrics and derivations."""
