"""Saved plans: actions, what they rest on, the import commands that carry them out, and whether they are stale."""
