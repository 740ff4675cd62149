"""tessera: prototype-based data reduction and classification as Spark DataFrame operations."""
