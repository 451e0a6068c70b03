"""Inspection, synthetic data and batches for training."""

from .data_gen import CatCol, ContCol, DatasetGen, LabelCol, PowerLawDistro, UniformDistro
from .inspector import DatasetInspector
from .loader import BatchLoader

__all__ = ["BatchLoader", "CatCol", "ContCol", "DatasetGen", "DatasetInspector", "LabelCol", "PowerLawDistro", "UniformDistro"]
