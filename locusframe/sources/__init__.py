"""Readers and writers of annotation text."""
