"""Plan helpers and named plans over the driver's tables."""
