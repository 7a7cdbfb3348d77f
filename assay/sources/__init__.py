"""Readers and writers of inputs, artifacts and the call log."""
