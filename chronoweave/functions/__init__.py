"""See the package overview in README.md."""
