"""Ledgerloom operators."""
