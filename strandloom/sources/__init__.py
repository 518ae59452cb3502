"""Readers and writers of the text formats around variant calling. Readers give typed DataFrames, lazily."""
