"""Relational, ordered, spatial and graph operators as DataFrame compositions."""
