"""gridloom: PySpark-native profiling, encoding, self-organising maps and lattice clustering."""

__version__ = "0.1.0"
