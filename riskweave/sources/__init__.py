"""Readers that make the engine's tables, and writers of its reports."""
