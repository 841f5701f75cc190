"""plans of the trajectory analytics library."""
