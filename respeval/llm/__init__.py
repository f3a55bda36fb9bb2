"""Operators of a pipeline for training data, over tables of documents and web pages."""
