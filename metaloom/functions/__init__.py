"""Scalar functions: canonical JSON, identities, pointers and text."""
