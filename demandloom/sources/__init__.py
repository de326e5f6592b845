"""Readers, writers and the tables that hold results."""
