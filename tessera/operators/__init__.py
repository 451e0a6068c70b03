"""All operators."""

from .agg import Groupby, JoinGroupby, TargetEncoding
from .base import LambdaOp, Operator, SerializationError, StatOperator
from .cat import Categorify, get_embedding_sizes
from .meta import AddMetadata, AddProperties, AddTags, DropLowCardinality, Rename, TagAsItemFeatures, TagAsItemID, TagAsUserFeatures, TagAsUserID, ValueCount
from .rel import ColumnSimilarity, DifferenceLag, Dropna, Filter, JoinExternal
from .row import Bucketize, Clip, FillMissing, HashBucket, HashedCross, ListSlice, LogOp
from .stat import DataStats, FillMedian, Normalize, NormalizeMinMax, ReduceDtypeSize

__all__ = [
    "AddMetadata", "AddProperties", "AddTags", "Bucketize", "Categorify", "Clip", "ColumnSimilarity", "DataStats", "DifferenceLag", "DropLowCardinality", "Dropna", "FillMedian", "FillMissing", "Filter", "Groupby", "HashBucket", "HashedCross", "JoinExternal", "JoinGroupby", "LambdaOp", "ListSlice", "LogOp", "Normalize", "NormalizeMinMax", "Operator", "ReduceDtypeSize", "Rename", "SerializationError", "StatOperator", "TagAsItemFeatures", "TagAsItemID", "TagAsUserFeatures", "TagAsUserID", "TargetEncoding", "ValueCount", "get_embedding_sizes",
]
