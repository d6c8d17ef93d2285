"""Readers that give paragraph tables."""
