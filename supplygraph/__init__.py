"""Supply-chain exposure analytics as ordinary Spark jobs."""
