"""Tessera: column operators composed into graphs, fitted and run on Spark."""

from . import operators as ops
from .graph import ColumnGroup, ColumnSelector, Node, Subgraph
from .operators import get_embedding_sizes
from .schema import ColumnSchema, Schema, Tags
from .sources import Dataset, Shuffle
from .workflow import Workflow

__all__ = ["ColumnGroup", "ColumnSchema", "ColumnSelector", "Dataset", "Node", "Schema", "Shuffle", "Subgraph", "Tags", "Workflow", "get_embedding_sizes", "ops"]
