"""dustline: film-scan repair and table analytics expressed as Spark plans."""
