"""Readers of metadata documents and catalogs, as graphs and property observations."""
