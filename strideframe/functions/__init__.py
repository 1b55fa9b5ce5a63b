"""Column-level helpers: vectors, angles, quaternions, names, terrain, filter taps."""
