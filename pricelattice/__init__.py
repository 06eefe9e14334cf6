"""pricelattice: price-catalogue analytics as DataFrame-to-DataFrame operators on PySpark."""

__version__ = "0.1.0"
