"""Land-cover change analytics expressed as PySpark DataFrame programs."""
