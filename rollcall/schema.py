"""Table schemas.  Library readers never infer."""

from __future__ import annotations

from pyspark.sql import types as T


def struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in fields])


TEXT, REAL, LONG, INT, FLAG = T.StringType(), T.DoubleType(), T.LongType(), T.IntegerType(), T.BooleanType()

# raw manifest cells are text; numbers are made by the rule cascade
MANIFEST = struct(*[(n, TEXT) for n in ("entity_id", "source", "label", "height", "weight", "age", "audio_paths")])
MANIFEST_COLUMNS = tuple(MANIFEST.fieldNames())

ITEM_QC = struct(
    ("path", TEXT), ("sha256", TEXT), ("duration", REAL), ("rate", INT), ("channels", INT), ("sample_width", INT),
    ("rms", REAL), ("peak", REAL), ("clipping", REAL), ("error", TEXT),
)

ITEM_FEATURES = struct(
    ("item_id", LONG), ("entity_id", LONG), ("quality", REAL), ("speech", REAL), ("snr", REAL), ("voiced", REAL), ("drift", REAL),
    ("is_augmented", FLAG), ("split", TEXT),
)
# values of optional item fields that a store does not have
ITEM_DEFAULTS = {"quality": 0.5, "speech": 0.7, "snr": 15.0, "voiced": 0.75, "is_augmented": False}

METRIC_LOG = struct(
    ("run", LONG), ("epoch", LONG), ("val", T.MapType(TEXT, REAL)), ("monitor_name", TEXT), ("monitor_value", REAL), ("lr", REAL)
)
