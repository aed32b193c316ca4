"""Reading and writing of clouds, normals, poses and instances."""
