"""Sources and sinks: files, catalog, strict load, reports."""
