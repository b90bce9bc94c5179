"""tidewell: seeded data generation, stream ingest, relational and graph
analytics and table contracts, all as Spark DataFrame plans."""

__version__ = "0.1.0"
