"""Point-in-time, mixed-frequency panel analytics expressed as Spark plans."""
