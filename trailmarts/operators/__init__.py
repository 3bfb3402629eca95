"""DataFrame to DataFrame operators over typed tables."""
