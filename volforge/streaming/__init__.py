"""Structured Streaming jobs: incremental price upserts (ST1) and job-state folding (ST2)."""
