"""Keyed event timelines, strict-prior features and their serving queries on Spark."""
