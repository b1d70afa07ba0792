"""See the package docstring of meshloom."""
