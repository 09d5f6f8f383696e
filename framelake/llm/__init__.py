"""Operators for training-data pipelines: tokenising, filtering, scoring, joining and placing documents."""
