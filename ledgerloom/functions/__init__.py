"""Ledgerloom functions."""
