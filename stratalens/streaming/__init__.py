"""streaming of the profiling library."""
