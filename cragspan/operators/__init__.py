"""Operators on clouds ``(pid, x, y, z, ...)``, meshes, rasters and survey points."""
