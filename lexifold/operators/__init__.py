"""Operators over whole tables: record stages, reducers, vectors, graphs, maintenance."""
