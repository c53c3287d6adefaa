"""Operators of a training-data pipeline over the tables documents, labels and benchmark."""
