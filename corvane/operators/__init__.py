"""DataFrame-to-DataFrame operators on ordered signals, vectors and tokens."""
