"""Catalogue, purchase-sequence and semantic-identifier analytics on Spark."""
