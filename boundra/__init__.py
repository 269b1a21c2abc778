"""Spark operators over territorial registers: boundaries, addresses, streets and their snapshots."""
