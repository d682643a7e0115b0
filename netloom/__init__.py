"""netloom: alignment analytics for georeferenced networks, expressed as PySpark DataFrames."""
