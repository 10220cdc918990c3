"""Linguistic rules: tables that operators take as parameters."""
