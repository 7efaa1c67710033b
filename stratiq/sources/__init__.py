"""Readers, writers, the artefact registry and scratch tables."""
