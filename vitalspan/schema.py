"""Column layouts of the stored stages."""

from __future__ import annotations

from pyspark.sql import types as T

from vitalspan.config import EXTRA_COLUMNS

TEXT, LONG, SHORT = T.StringType(), T.LongType(), T.ShortType()
INSTANT, REAL, DAY = T.TimestampNTZType(), T.FloatType(), T.DateType()


def _layout(*columns: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in columns])


def _channel(name: str) -> list[tuple[str, T.DataType]]:
    return [*[(f"{name}_{i}", SHORT) for i in range(4)], (f"{name}_SignalQuality", TEXT)]


EXTRAS = [(c, TEXT) for c in EXTRA_COLUMNS]
MODES = [(c, TEXT) for c in ("Hr1Mode", "Hr2Mode", "MhrMode", "TocoMode")]
SIGNALS = [("FHR", REAL), ("toco", REAL)]

RAW_FLAT = _layout(
    ("PatientID", TEXT), ("RegistrationID", LONG), ("Timestamp", INSTANT), *MODES, ("Toco_Values", TEXT),
    *_channel("Hr1"), *_channel("Hr2"), *_channel("Mhr"),
)
DERIVED = _layout(("Timestamp", INSTANT), ("PatientID", TEXT), ("RegistrationID", LONG), *SIGNALS, *EXTRAS)
CLOSING = _layout(("BabyID", TEXT), *[(f.name, f.dataType) for f in DERIVED.fields])
VOTED = _layout(("BabyID", TEXT), ("PatientID", TEXT), ("Timestamp", INSTANT), *SIGNALS, *EXTRAS)
DATED = _layout(*[(f.name, f.dataType) for f in VOTED.fields], ("ctg_date", DAY))
FINAL_SERIES = _layout(("BabyID", TEXT), ("Timestamp", INSTANT), *SIGNALS, *EXTRAS)
