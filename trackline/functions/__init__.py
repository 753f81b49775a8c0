"""Column functions: text, geometry on the sphere, calendar."""
