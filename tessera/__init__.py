"""tessera: a PySpark-native analytics engine for posting, notice and event data."""
