"""Inputs: snapshots, catalogs, file layouts, logs and versioned tables."""
