"""Block-parallel bzip2 on Spark: codec, metadata tables, integrity checks and file access."""
