"""Same session as the other tests."""
