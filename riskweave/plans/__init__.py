"""Whole plans: the scan, and the registered queries."""
