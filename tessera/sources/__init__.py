"""Reading and writing."""

from .dataset import Dataset, Shuffle

__all__ = ["Dataset", "Shuffle"]
