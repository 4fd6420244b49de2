"""Explicit schemas of the inputs."""

from __future__ import annotations

from pyspark.sql import types as T


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


# Fixed values from here on: field names of the external inputs, in their order.
S, D, I, L = T.StringType(), T.DoubleType(), T.IntegerType(), T.LongType()

# Report files are read as text; every cast happens afterwards and can fail per row.
STORM_REPORT = _struct(**{c: S for c in ("yr", "date", "time", "mag", "slat", "slon", "st")})

STATION_COLLECTION = _struct(features=T.ArrayType(_struct(id=S, geometry=_struct(coordinates=T.ArrayType(D)))))

MANIFEST_TEXT = _struct(
    **{c: S for c in ("event_id", "label", "class", "subtype", "station", "mag", "event_lat", "event_lon", "dist_km", "date", "scan_time", "refl", "vel")}
)
TENSOR_MANIFEST_TEXT = _struct(
    **{c: S for c in ("event_id", "label", "class", "subtype", "station", "mag", "date", "scan_time", "dist_km", "tensor", "has_velocity")}
)

_SIZE = _struct(width=I, height=I)
GRID = _struct(
    metadata=_struct(
        radar_type=S, original_dimensions=_SIZE, sampled_dimensions=_SIZE, sample_rate=I, units=S, value_range=_struct(min=D, max=D), source_file=S
    ),
    data=T.ArrayType(T.ArrayType(D)),
)

ALERT_PROPERTIES = _struct(
    **{
        c: S
        for c in (
            "id", "areaDesc", "sent", "effective", "onset", "expires", "ends", "status", "messageType", "category", "severity", "certainty",
            "urgency", "event", "sender", "senderName", "headline", "description", "instruction", "response",
        )
    }
)
ALERT_COLLECTION = _struct(features=T.ArrayType(_struct(properties=ALERT_PROPERTIES)))

RECIPIENT_RESULT = _struct(to=S, err=S)
LEDGER_ROW = _struct(
    alert_id=S, event_type=S, sent_at=S, outcome=S, model_state=S, score=D, threshold=D,
    recipients_ok=T.ArrayType(S), recipients_failed=T.ArrayType(RECIPIENT_RESULT), reason=S,
)

SCORE_STATUS = _struct(
    status=S, last_score=D, last_score_time=S, last_scan_time=S, scan_delta_seconds=I, pair_n0b_file=S, pair_n0s_file=S, model_sha256=S,
    preprocess_version=S, threshold=D, cycle_ms=T.MapType(S, I), errors=T.ArrayType(_struct(time=S, kind=S, msg=S)), _corrupt_record=S,
)

_READING = _struct(value=D)
OBSERVATION = _struct(
    properties=_struct(
        timestamp=S, station=S, temperature=_READING, dewpoint=_READING, relativeHumidity=_READING, windSpeed=_READING, windDirection=_READING,
        textDescription=S, barometricPressure=_READING, visibility=_READING,
    )
)
FORECAST_PERIOD = _struct(name=S, temperature=I, temperatureUnit=S, windSpeed=S, windDirection=S, shortForecast=S)
FORECAST = _struct(properties=_struct(periods=T.ArrayType(FORECAST_PERIOD)))

MODEL_MANIFEST = _struct(model_sha256=S, preprocess_version=S, threshold_recommended=D)

FRAME_FILE = _struct(path=S, modificationTime=T.TimestampType(), length=L, content=T.BinaryType())

SERVICE_STATUS = _struct(
    service=S, status=S, current_status=S, total_captured=L, total_processed=L, total_errors=L, last_processed=S, last_processed_time=S,
    last_capture_file=S, last_capture_time=S, _corrupt_record=S,
)
