"""Landing readers, table load/verify, versioned forecast publishing."""
