"""sources of the profiling library."""
