"""DataFrame-to-DataFrame profile operators."""
