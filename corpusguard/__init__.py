"""Corpus analytics on Spark: chunking, risk scoring, retrieval and evaluation."""
