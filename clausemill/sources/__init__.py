"""Readers, upload checks and writers."""
