"""operators of the profiling library."""
