"""Whole flows built from the operators: ingest, reviews, signals, triage, evaluation."""
