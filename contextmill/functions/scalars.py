"""Token estimates, content identity, paths, enum normalisers and display formats."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

ColumnLike = Column | str


def as_col(value: ColumnLike) -> Column:
    return F.col(value) if isinstance(value, str) else value


# --- size and identity -------------------------------------------------------------------------

def token_estimate(text: ColumnLike) -> Column:
    """Bytes divided by four, rounded down; an absent text counts 0."""
    return F.shiftright(F.coalesce(F.octet_length(as_col(text)), F.lit(0)), 2)


def json_token_estimate(payload: Column, extra_bytes: Column | int = 0) -> Column:
    """Token estimate of a JSON payload whose encoder writes <, >, & and U+2028/9 as six-byte escapes.

    extra_bytes accounts for fields of the row that are kept outside the payload column.
    """
    extra = extra_bytes if isinstance(extra_bytes, Column) else F.lit(extra_bytes)
    size = F.octet_length(payload)
    html = size - F.octet_length(F.translate(payload, "<>&", ""))
    separators = size - F.octet_length(F.translate(payload, "\u2028\u2029", ""))
    return F.shiftright(size + 5 * html + separators + extra, 2)


def content_hash(text: ColumnLike) -> Column:
    """First 16 bytes of SHA-256, in hex."""
    return F.substring(F.sha2(as_col(text), 256), 1, 32)


def byte_prefix(text: ColumnLike, n: int) -> Column:
    """The first n *bytes* of a text, as binary."""
    return F.substring(as_col(text).cast("binary"), 1, n)


def embed_hash(kind: ColumnLike, name: ColumnLike, source: ColumnLike) -> Column:
    """Identity of the embedded text '<kind> <name>: <first 500 bytes of source>'."""
    head = F.concat(as_col(kind), F.lit(" "), as_col(name), F.lit(": ")).cast("binary")
    return content_hash(F.concat(head, byte_prefix(source, 500)))


def stable_ref(prefix: str, *parts: ColumnLike) -> Column:
    """Replayable reference: prefix plus 12 hex characters of a hash over the identifying parts."""
    joined = F.concat_ws("\u0001", *[as_col(p).cast("string") for p in parts])
    return F.concat(F.lit(prefix), F.substring(F.sha2(joined, 256), 1, 12))


def blank_to_null(text: ColumnLike) -> Column:
    return F.nullif(as_col(text), F.lit(""))


def trim_space(text: ColumnLike) -> Column:
    """Trim all white space (not only blanks) at both ends."""
    return F.regexp_replace(as_col(text), r"^\s+|\s+$", "")


# --- paths -------------------------------------------------------------------------------------

def basename(path: ColumnLike) -> Column:
    return F.element_at(F.split(as_col(path), "/"), -1)


def dirname(path: ColumnLike) -> Column:
    """Directory of a relative path, '.' at the root."""
    directory = F.regexp_replace(as_col(path), "/?[^/]*$", "")
    return F.when(directory == "", F.lit(".")).otherwise(directory)


def relative_path(path: ColumnLike, root: ColumnLike) -> Column:
    """Path below root, or the path itself when it lies elsewhere."""
    p, r = as_col(path), as_col(root)
    return F.when(F.startswith(p, F.concat(r, F.lit("/"))),
                  F.substr(p, F.length(r) + F.lit(2))).otherwise(p)


def ancestors(path: ColumnLike) -> Column:
    """Array of the strict ancestors of an absolute path, nearest last ('/a/b/c' -> ['/a','/a/b'])."""
    parts = F.split(as_col(path), "/")
    depth = F.size(parts)
    found = F.transform(F.sequence(F.lit(2), F.greatest(depth - 1, F.lit(2))),
                        lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    return F.when(depth > 2, found).otherwise(F.array().cast("array<string>"))


# --- enum normalisers --------------------------------------------------------------------------

# Accepted spellings of the enumerations.
MEMORY_SCOPES = ("session", "project", "global")
REPAIR_REASONS = ("cache_miss", "quality", "manual", "proactive")
REPAIR_OUTCOMES = ("success", "failed", "skipped")
TOOL_TIERS = ("core", "extended", "complete")


def _one_of(value: ColumnLike, allowed: tuple[str, ...], default: str | None) -> Column:
    folded = F.lower(F.trim(as_col(value)))
    return F.when(folded.isin(*allowed), folded).otherwise(F.lit(default))


def normalize_reason(value: ColumnLike) -> Column:
    return _one_of(value, REPAIR_REASONS, "")


def normalize_outcome(value: ColumnLike) -> Column:
    return _one_of(value, REPAIR_OUTCOMES, "")


def normalize_tier(value: ColumnLike) -> Column:
    return _one_of(value, TOOL_TIERS, "core")


def normalize_scope(scope: ColumnLike, session_id: ColumnLike, project_path: ColumnLike) -> Column:
    """Effective memory scope, null where the scope is unknown or its owner is missing."""
    s = F.coalesce(as_col(scope), F.lit(""))
    has_session = F.trim(F.coalesce(as_col(session_id), F.lit(""))) != ""
    has_project = F.trim(F.coalesce(as_col(project_path), F.lit(""))) != ""
    return (F.when(s.isin("", "session") & has_session, F.lit("session"))
            .when((s == "project") & has_project, F.lit("project"))
            .when(s == "global", F.lit("global")))


# --- numbers and formats -----------------------------------------------------------------------

def clamp_zero(value: Column) -> Column:
    return F.greatest(value, F.lit(0))


def percent_of(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole * 100).otherwise(F.lit(0.0))


def share_label(pct: Column) -> Column:
    """'12%' from ten percent on, '3.4%' below."""
    return F.when(pct >= 10, F.format_string("%.0f%%", pct)).otherwise(F.format_string("%.1f%%", pct))


def quota_text(used: Column, limit: int) -> Column:
    return F.concat(used.cast("string"), F.lit(f"/{limit}"))


def human_size(size: ColumnLike) -> Column:
    """B, KB, MB or GB with one decimal above bytes."""
    n = as_col(size).cast("double")
    return (F.when(n >= 1 << 30, F.format_string("%.1f GB", n / (1 << 30)))
            .when(n >= 1 << 20, F.format_string("%.1f MB", n / (1 << 20)))
            .when(n >= 1 << 10, F.format_string("%.1f KB", n / (1 << 10)))
            .otherwise(F.format_string("%d B", as_col(size).cast("long"))))


def escape_xml(text: ColumnLike) -> Column:
    out = as_col(text)
    for raw, escaped in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(raw), F.lit(escaped))
    return out


def micros(ts: ColumnLike) -> Column:
    """Microseconds since 1970 of a wall-clock timestamp, whatever the session time zone."""
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return F.timestamp_diff("MICROSECOND", epoch, as_col(ts).cast("timestamp_ntz"))


def relative_time(ts: ColumnLike, now: ColumnLike) -> Column:
    """'just now', '30s ago', '5m ago', '3h ago', '2d ago' relative to a given instant; after a week the date ('Jan 2 15:04')."""
    seconds = F.unix_timestamp(as_col(now)) - F.unix_timestamp(as_col(ts))
    return (F.when(seconds < 10, F.lit("just now"))
            .when(seconds < 60, F.concat(seconds.cast("string"), F.lit("s ago")))
            .when(seconds < 3600, F.concat(F.floor(seconds / 60).cast("string"), F.lit("m ago")))
            .when(seconds < 86400, F.concat(F.floor(seconds / 3600).cast("string"), F.lit("h ago")))
            .when(seconds < 7 * 86400, F.concat(F.floor(seconds / 86400).cast("string"), F.lit("d ago")))
            .otherwise(F.date_format(as_col(ts), "MMM d HH:mm")))


def hourly_session(ts: ColumnLike) -> Column:
    """Default session id: one per clock hour."""
    return F.concat(F.lit("session-"), F.floor(F.unix_timestamp(as_col(ts)) / 3600).cast("string"))


def argument(json_text: ColumnLike, name: str) -> Column:
    """A logged call argument, either wrapped in 'arguments' or at the top level."""
    j = as_col(json_text)
    return F.coalesce(F.get_json_object(j, f"$.arguments.{name}"), F.get_json_object(j, f"$.{name}"))


def is_stale(last_updated: ColumnLike, now: ColumnLike, max_age_days: int = 7) -> Column:
    """True for a missing or unreadable RFC 3339 instant and for one at least max_age_days old."""
    parsed = F.try_to_timestamp(as_col(last_updated))
    age = F.unix_timestamp(as_col(now)) - F.unix_timestamp(parsed)
    return F.coalesce(age >= max_age_days * 86400, F.lit(True))


# --- savings -----------------------------------------------------------------------------------

def tokens_saved(used: Column, symbol_baseline: Column, dedup: Column) -> Column:
    return clamp_zero(symbol_baseline - used) + dedup


def saved_vs_files(used: Column, file_baseline: Column, dedup: Column) -> Column:
    return clamp_zero(file_baseline - used) + dedup
