"""Part of the meshlark engine."""
