"""meshlark: a PySpark-native engine for trajectory, adaptive-mesh and training-corpus data."""

__version__ = "0.1.0"
