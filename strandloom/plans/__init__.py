"""Whole workflows as one lazy plan each."""
