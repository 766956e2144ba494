"""Ledgerloom streaming."""
