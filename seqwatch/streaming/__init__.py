"""Jobs over data that keeps landing."""
