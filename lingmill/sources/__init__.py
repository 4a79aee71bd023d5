"""Readers and writers of the text formats."""
