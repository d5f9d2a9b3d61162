"""Rules for identifiers, timestamps and paths as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns of a version-7 UUID and of an accepted timestamp.
UUID_V7 = r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-7[0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}$"
TIMESTAMP = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-5][0-9](?:\.[0-9]+)?(?:Z|[+-][0-9]{2}:[0-9]{2})$"


def is_uuid_v7(value: Column) -> Column:
    return F.coalesce(value.rlike(UUID_V7), F.lit(False))


def uuid_v7_epoch_ms(value: Column) -> Column:
    """Milliseconds in the first 48 bits; null unless the value is a version-7 UUID."""
    digits = F.concat(F.substring(value, 1, 8), F.substring(value, 10, 4))
    return F.when(is_uuid_v7(value), F.conv(digits, 16, 10).cast("long"))


def timestamp_epoch_ms(value: Column) -> Column:
    """Milliseconds since 1970 of a strict ISO timestamp with seconds and zone, rounded down; null for anything else."""
    return F.when(value.rlike(TIMESTAMP) & ~value.startswith("0000"), F.unix_millis(value.try_cast("timestamp")))


def project_name(cwd: Column) -> Column:
    """Last segment of a working directory; `Codex` where there is none."""
    trimmed = F.regexp_replace(F.regexp_replace(cwd, r"^\s+|\s+$", ""), r"[\\/]+$", "")
    last = F.regexp_extract(trimmed, r"([^\\/]*)$", 1)
    return F.when(last.isNull() | (F.trim(last) == ""), "Codex").otherwise(last)


def fallback_rollout_id(path: Column) -> Column:
    """Id from a log file's name: a trailing version-7 UUID in lower case, else what follows the second dash."""
    name = F.regexp_replace(F.element_at(F.split(path, r"[\\/]"), -1), r"(?i)\.jsonl$", "")
    tail = F.when(F.length(name) >= 36, F.substring(name, -36, 36))
    legacy = F.regexp_extract(name, r"^[^-]*-[^-]*-(.+)$", 1)
    return F.when(is_uuid_v7(tail), F.lower(tail)).when(legacy != "", legacy).otherwise(name)


def legacy_rollout_id(path: Column) -> Column:
    """What follows the second dash of a log file's name, as ids were taken from names before."""
    name = F.regexp_replace(F.element_at(F.split(path, r"[\\/]"), -1), r"(?i)\.jsonl$", "")
    legacy = F.regexp_extract(name, r"^[^-]*-[^-]*-(.+)$", 1)
    return F.when(legacy != "", legacy).otherwise(name)


def normalized_id(text: Column) -> Column:
    """A typed conversation id: trimmed, in lower case if it is a version-7 UUID, else null."""
    return F.when(is_uuid_v7(F.trim(text)), F.lower(F.trim(text)))


def thread_label(project: Column, conversation: Column, title: Column) -> Column:
    return F.concat_ws(" - ", project, F.substring(conversation, 1, 12), F.when(title != "", title).otherwise("untitled"))


def source_identity(path: Column, length: Column, modified: Column) -> Column:
    return F.concat_ws("|", path, length.cast("string"), F.unix_millis(modified).cast("string"))
