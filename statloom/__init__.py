"""statloom: statistical analytics and data processing expressed as Spark plans."""
