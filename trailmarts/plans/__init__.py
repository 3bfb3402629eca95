"""Reports that span sessions."""
