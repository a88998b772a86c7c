"""Where results go: artifacts with a content identity, and short reports for people."""
