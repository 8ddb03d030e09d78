"""Incremental jobs: resumable stages and the streaming triage."""
