"""DataFrame operators on tables of clouds, poses, pixels and instances."""
