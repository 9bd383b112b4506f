"""Tables: external Parquet data and the engine's own store."""
