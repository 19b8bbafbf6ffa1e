"""DataFrame -> DataFrame operators; no driver actions inside."""
