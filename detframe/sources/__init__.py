"""Readers and writers of annotation, label, configuration and trial files."""
