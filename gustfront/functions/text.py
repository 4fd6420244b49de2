"""Alert wording, report lines and small text helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gustfront.constants import ALLOWED_EVENTS, EVENT_CODES, MAX_SCORE_AGE_SECONDS
from gustfront.functions.numbers import fixed_text

DASH = "—"
RULE = "=" * 60


def utc_text(ts: Column) -> Column:
    """Instant as ISO text with a trailing Z (session time zone is UTC)."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def parse_iso(text: Column) -> Column:
    """ISO date-time with or without offset; anything else is NULL."""
    return F.trim(text).try_cast("timestamp")


def csv_list(text: Column) -> Column:
    """Comma list, trimmed, blanks dropped."""
    parts = F.transform(F.split(F.coalesce(text, F.lit("")), ","), lambda x: F.trim(x))
    return F.filter(parts, lambda x: x != "")


def event_code(event: Column) -> Column:
    """Short code of an event; others take up to four initials."""
    words = F.filter(F.split(F.trim(event), r"\s+"), lambda w: w != "")
    initials = F.substring(F.array_join(F.transform(words, lambda w: F.substring(w, 1, 1)), ""), 1, 4)
    known = F.create_map(*[F.lit(x) for pair in EVENT_CODES.items() for x in pair])
    return F.coalesce(
        F.when(event.isin(*ALLOWED_EVENTS), F.element_at(known, event)),
        F.upper(F.when(initials != "", initials).otherwise("ALRT")),
    )


def model_state(
    score: Column, status: Column, age_seconds: Column, threshold: float, max_age: int = MAX_SCORE_AGE_SECONDS
) -> Column:
    """Readout label: 'elevated', 'not elevated' or 'unavailable'."""
    missing = score.isNull() | status.isNull() | status.isin("uninitialized", "error")
    old = age_seconds.isNull() | (age_seconds > max_age) | (status == "stale")
    return (
        F.when(missing | old, "unavailable").when(score >= threshold, "elevated").otherwise("not elevated")
    )


def shown_score(score: Column, status: Column) -> Column:
    """The score that accompanies the label: kept when merely stale, dropped on error."""
    return F.when(status.isNotNull() & ~status.isin("uninitialized", "error"), score)


def _or_dash(value: Column) -> Column:
    return F.coalesce(F.when(value != "", value), F.lit(DASH))


def _score_text(score: Column) -> Column:
    return F.coalesce(fixed_text(score, 2), F.lit(DASH))


# Wording of the notifications and of the report.
READOUT_LINES = ("EXPERIMENTAL MODEL READOUT — informational only, NOT an alert.\n\nRadar-signature confidence: ", "\n  Score:     ", "\n  Threshold: ", "\n  Radar age: ", "\n  N0B/N0S Δ: ")
OLD_SCAN_NOTE = ("Note: most recent radar scan available to the model is ", "s old (>{}s threshold). The model readout is suppressed.")
FULL_LINES = (f" {DASH} National Weather Service\n", "\n\nArea:      ", "\nEffective: ", "\nExpires:   ", "\n\nINSTRUCTIONS (NWS):\n", "\n\nDESCRIPTION (NWS):\n", "\n\n" + "─" * 64 + "\n")
SHORT_LINES = ("Tornado Warning until ", ". Model ", " until ", ". Heed NWS. Full details emailed.")
CURRENT_LINES = (f"CURRENT WEATHER {DASH} ", "Observation: ", "Station: ", "Temperature: ", "Dewpoint: ", "Conditions: ")
FORECAST_LINES = (f"FORECAST {DASH} ", ":\n  Temp: ", "\n  Wind: ")
ELEVATED_TEXT = (
    "Score at or above threshold: radar features in this scan reach the model's tornadic-structure cutoff. "
    "This is NOT confirmation of a tornado on the ground — it is a single-frame radar-morphology score."
)
NOT_ELEVATED_TEXT = (
    "Score below threshold: radar features in this scan did not reach the model's tornadic-structure cutoff. "
    "This does NOT reduce the threat. Heed NWS guidance."
)
SUPPRESSED_TEXT = "Model readout suppressed (see note below)."
NO_SCORE_NOTE = "Note: the model has no recent score (service may be starting up)."
NOT_APPLICABLE_TEXT = (
    "EXPERIMENTAL MODEL READOUT — not applicable.\n\n"
    "The companion CNN scores tornadic radar signatures on KFWS only.\n"
    "It does not assess this event type. Treat this email as a direct\n"
    "relay of the NWS warning above.\n"
)
FOOTER_TEXT = (
    "This email is an automatic relay of an active NWS warning.\n"
    "The NWS guidance above is the authority. Heed it regardless of any\n"
    "model annotation.\n"
)


def tornado_readout(state, score, threshold, age, delta, max_age: int = MAX_SCORE_AGE_SECONDS) -> Column:
    """Mechanical model annotation for tornado warnings."""
    seconds = lambda c: F.coalesce(F.concat(c.cast("string"), F.lit("s")), F.lit(DASH))
    reading = F.when(state == "elevated", ELEVATED_TEXT).when(state == "not elevated", NOT_ELEVATED_TEXT).otherwise(SUPPRESSED_TEXT)
    old_note = F.concat(
        F.lit(OLD_SCAN_NOTE[0]), age.cast("string"), F.lit(OLD_SCAN_NOTE[1].format(max_age)),
    )
    note = F.when(
        state == "unavailable",
        F.concat(F.lit("\n"), F.when(score.isNotNull() & (age > max_age), old_note).otherwise(NO_SCORE_NOTE), F.lit("\n")),
    ).otherwise("")
    shown = (F.upper(state), _score_text(score), fixed_text(threshold, 2), seconds(age), seconds(delta))
    return F.concat(*[x for line, value in zip(READOUT_LINES, shown, strict=True) for x in (F.lit(line), value)], F.lit("\n\n"), reading, F.lit("\n"), note)


def full_subject(event, area, state) -> Column:
    area = _or_dash(area)
    plain = F.concat(event, F.lit(": "), area)
    return F.when(event == "Tornado Warning", F.concat(plain, F.lit(" (model: "), state, F.lit(")"))).otherwise(plain)


def full_body(event, area, headline, description, instruction, effective, expires, readout) -> Column:
    block = F.when(event == "Tornado Warning", readout).otherwise(NOT_APPLICABLE_TEXT)
    shown = (F.coalesce(F.when(headline != "", headline), event), *[_or_dash(c) for c in (area, effective, expires, instruction, description)], block)
    return F.concat(F.upper(event), *[x for line, value in zip(FULL_LINES, shown, strict=True) for x in (F.lit(line), value)], F.lit("\n" + FOOTER_TEXT))


_SHORT_STATE = {"elevated": "ELEVATED", "not elevated": "NOT ELEV"}


def _short_state(state: Column) -> Column:
    return F.when(state == "elevated", _SHORT_STATE["elevated"]).when(state == "not elevated", _SHORT_STATE["not elevated"]).otherwise("N/A")


def short_subject(event, area, state) -> Column:
    area = _or_dash(area)
    tornado = F.concat(event_code(event), F.lit(" "), F.substring(area, 1, 35), F.lit(" (model:"), _short_state(state), F.lit(")"))
    return F.when(event == "Tornado Warning", tornado).otherwise(F.concat(event_code(event), F.lit(" "), F.substring(area, 1, 40)))


def short_body(event, expires, state, score, threshold) -> Column:
    until = F.substring(F.coalesce(expires, F.lit("")), 1, 16)
    first, model, between, end = map(F.lit, SHORT_LINES)
    compared = F.concat(F.lit(" ("), _score_text(score), F.lit(" vs "), fixed_text(threshold, 2), F.lit(")"))
    tornado = F.concat(first, until, model, _short_state(state), compared, end)
    other = F.concat(event, between, until, end)
    return F.when(event == "Tornado Warning", tornado).otherwise(other)


def short_copy(text: Column, limit: int) -> Column:
    """The first characters of a text, not escaped."""
    return F.substring(text, 1, limit)


def html_escaped(text: Column) -> Column:
    """Escape markup, ampersand first."""
    kept = text
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        kept = F.replace(kept, F.lit(raw), F.lit(safe))
    return kept


def central_text(ts: Column) -> Column:
    """US Central wall-clock text with its CST/CDT tag, from the time-zone database."""
    local = F.from_utc_timestamp(ts, "America/Chicago")
    offset = (F.unix_timestamp(ts) - F.unix_timestamp(local)) / 3600
    return F.concat(F.date_format(local, "yyyy-MM-dd HH:mm:ss"), F.when(offset == 5, " CDT").otherwise(" CST"))


def age_text(ts: Column, as_of: Column) -> Column:
    """'just now', '12m ago', '3h 5m ago', or a dash without a time."""
    minutes = F.floor((F.unix_timestamp(as_of) - F.unix_timestamp(ts)) / 60)
    return (
        F.when(ts.isNull(), DASH)
        .when(minutes < 1, "just now")
        .when(minutes < 60, F.concat(minutes.cast("string"), F.lit("m ago")))
        .otherwise(F.concat(F.floor(minutes / 60).cast("string"), F.lit("h "), (minutes % 60).cast("string"), F.lit("m ago")))
    )


def short_name(name: Column) -> Column:
    """Names over 30 characters keep 14 at either end."""
    return (
        F.when(F.coalesce(name, F.lit("")) == "", DASH)
        .when(F.length(name) <= 30, name)
        .otherwise(F.concat(F.left(name, F.lit(14)), F.lit("…"), F.right(name, F.lit(14))))
    )


def service_tag(state: Column, inner: Column) -> Column:
    """Badge text from the container state and the service's own status."""
    return (
        F.when((state == "running") & F.coalesce(inner.isin("error", "Error"), F.lit(False)), "ERROR")
        .when((state == "running") & F.coalesce(inner == "Processing", F.lit(False)), "PROCESSING")
        .when(state == "running", "RUNNING")
        .when(state == "exited", "STOPPED")
        .when(state == "restarting", "RESTARTING")
        .otherwise("OFFLINE")
    )


# --- weather report lines ------------------------------------------------------------------------


def fahrenheit(celsius: Column) -> Column:
    return celsius * 9 / 5 + 32


def temperature_text(celsius: Column) -> Column:
    both = F.concat(fixed_text(fahrenheit(celsius), 1), F.lit("°F ("), fixed_text(celsius, 1), F.lit("°C)"))
    return F.coalesce(both, F.lit("N/A"))


def humidity_line(value: Column) -> Column:
    return F.concat(F.lit("Humidity: "), fixed_text(value, 0), F.lit("%"))


def wind_line(kmh: Column, degrees: Column) -> Column:
    """Wind in mph; a direction of 0 or NULL is not printed."""
    source = F.when(degrees != 0, F.concat(F.lit(" from "), degrees.cast("int").cast("string"), F.lit("°"))).otherwise("")
    return F.concat(F.lit("Wind: "), fixed_text(kmh * 0.621371, 1), F.lit(" mph"), source)


def pressure_line(pascal: Column) -> Column:
    return F.when(pascal != 0, F.concat(F.lit("Pressure: "), fixed_text(pascal / 3386.39, 2), F.lit(" inHg")))


def visibility_line(metres: Column) -> Column:
    return F.when(metres != 0, F.concat(F.lit("Visibility: "), fixed_text(metres / 1609.34, 1), F.lit(" miles")))


def current_section(ts, station, temp, dew, humidity, wind, direction, conditions, pressure, visibility, place: str) -> Column:
    """Current-conditions section; absent readings leave no line."""
    lines = F.array(
        F.lit(RULE), F.lit(CURRENT_LINES[0] + place), F.lit(RULE),
        F.concat(F.lit(CURRENT_LINES[1]), F.date_format(ts, "yyyy-MM-dd hh:mm a"), F.lit(" UTC")),
        F.concat(F.lit(CURRENT_LINES[2]), F.substring_index(station, "/", -1)),
        F.concat(F.lit(CURRENT_LINES[3]), temperature_text(temp)), F.concat(F.lit(CURRENT_LINES[4]), temperature_text(dew)),
        humidity_line(humidity), wind_line(wind, direction),
        F.when(conditions != "", F.concat(F.lit(CURRENT_LINES[5]), conditions)), pressure_line(pressure), visibility_line(visibility), F.lit(RULE),
    )
    return F.array_join(F.array_compact(lines), "\n")


def forecast_section(periods: Column, place: str, first: int = 5) -> Column:
    """First five forecast periods as text; ``periods`` is an array of structs."""
    blocks = F.transform(
        F.slice(periods, 1, first),
        lambda p: F.concat(
            F.lit("\n"), F.coalesce(p["name"], F.lit("?")), F.lit(FORECAST_LINES[1]), F.coalesce(p["temperature"].cast("string"), F.lit("None")),
            F.lit("°"), F.coalesce(p["temperatureUnit"], F.lit("F")), F.lit(FORECAST_LINES[2]), F.coalesce(p["windSpeed"], F.lit("N/A")),
            F.lit(" "), F.coalesce(p["windDirection"], F.lit("")), F.lit("\n  "), F.coalesce(p["shortForecast"], F.lit("")),
        ),
    )
    head = F.array(F.lit("\n" + RULE), F.lit(FORECAST_LINES[0] + place), F.lit(RULE))
    return F.array_join(F.concat(head, blocks, F.array(F.lit("\n" + RULE))), "\n")


def alert_lines(event: Column, severity: Column, headline: Column) -> Column:
    first = F.concat(F.lit("\n\U0001f6a8 "), F.coalesce(event, F.lit("?")), F.lit(" ("), F.coalesce(severity, F.lit("?")), F.lit(")"))
    return F.when(F.coalesce(headline, F.lit("")) != "", F.concat(first, F.lit("\n   "), headline)).otherwise(first)
