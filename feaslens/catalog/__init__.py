"""Registered queries by topic. Modules are imported by the driver entry."""

MODULES = ["columns", "metrics", "bootstrap", "splits", "matching", "tracks", "labels", "scores", "occupancy", "audits", "jobs"]
