"""Document sources and sinks: binary files to object, edge, page and instruction tables."""
