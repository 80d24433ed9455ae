"""Readers and writers: tab-separated dumps, the single-file bundle, SQLite files, Parquet stores."""
