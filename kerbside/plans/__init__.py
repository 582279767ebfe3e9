"""User-level jobs: building the curated tables and querying them."""
