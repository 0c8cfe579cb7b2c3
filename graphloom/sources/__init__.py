"""Inputs: the table adapter, files, version-control output, catalogs."""
