"""Ledgerloom plans."""
