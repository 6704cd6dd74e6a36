"""Terms and filters."""
