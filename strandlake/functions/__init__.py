"""See the package docstring in strandlake/__init__.py."""
