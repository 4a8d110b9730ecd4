"""Sievemill: collecting, normalising, classifying and reconciling postings on Spark."""
