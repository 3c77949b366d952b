"""Models: the prefilter and adapters of external ones."""
