"""End-to-end jobs: ingestion, answering, health."""
