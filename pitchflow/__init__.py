"""pitchflow: tracking-data analytics as declarative Spark plans."""
