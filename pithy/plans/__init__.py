"""Composite operators and the registered queries."""
