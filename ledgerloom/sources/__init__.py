"""Ledgerloom sources."""
