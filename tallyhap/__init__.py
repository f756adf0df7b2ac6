"""Allele and depth counting over aligned reads, as Spark DataFrame plans."""

__version__ = "0.1.0"
