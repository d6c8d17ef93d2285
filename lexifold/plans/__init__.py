"""Registered queries and the pipeline compiler."""
