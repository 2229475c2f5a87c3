"""Pairwise inference and network reconstruction over Spark DataFrames."""

NAME = "pairwright"
VERSION_INFO = (0, 1, 0)
__version__ = ".".join(map(str, VERSION_INFO))
