"""Sources (readers, sibling discovery) and the report store."""
