"""plans of the profiling library."""
