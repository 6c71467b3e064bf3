"""Tables: ingestion, versions, catalog, sinks."""
