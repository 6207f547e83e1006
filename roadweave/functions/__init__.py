"""Column functions: angles, geometry, projection and road tags."""
