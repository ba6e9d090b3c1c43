"""Readers for GeoJSON, OpenStreetMap extracts, area configurations and registries."""
