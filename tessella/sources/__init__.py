"""Readers of captured pages and of what they carry."""
