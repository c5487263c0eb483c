"""Files of meshes, palettes and jobs."""
