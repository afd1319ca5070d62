"""DataFrame operators: turtle, paths, voxels, images."""
