"""veilframe: personal data and secret detection, pseudonymization and restoration on Spark."""

__version__ = "0.1.0"
