"""Logical input tables: warehouse read/write, the test-data adapter, snapshots, key checks."""
