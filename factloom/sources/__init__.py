"""Where facts come from: projections of tables, Parquet stores, documents, binaries, configuration."""
