"""DataFrame -> DataFrame operators. Each is a lazy plan fragment."""
