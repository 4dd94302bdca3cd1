"""functions of the profiling library."""
