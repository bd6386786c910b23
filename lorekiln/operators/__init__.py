"""DataFrame -> DataFrame: ingest, storage, search, mining, life cycle and rendering."""
