"""Flow-table analytics expressed as Spark DataFrame programs."""
