"""Spark analytics over code corpora and the questions asked about them."""
