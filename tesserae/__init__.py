"""Corpus analytics on Spark: tables of notes in, DataFrames out."""
