"""Column expressions of the catalogue: keys, extensions, versions, types, sizes. All are built-in functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Extension and content type, as stored objects are labelled.
CONTENT_TYPES = {
    ".pdf": "application/pdf",
    ".doc": "application/msword",
    ".docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
    ".xls": "application/vnd.ms-excel",
    ".xlsx": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet",
    ".ppt": "application/vnd.ms-powerpoint",
    ".pptx": "application/vnd.openxmlformats-officedocument.presentationml.presentation",
    ".csv": "text/csv",
    ".txt": "text/plain",
    ".jpg": "image/jpeg",
    ".jpeg": "image/jpeg",
    ".png": "image/png",
}
UNKNOWN_TYPE = "application/octet-stream"


def c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def norm_device(code: Column | str) -> Column:
    """Trimmed and in upper case."""
    return F.upper(F.trim(c(code)))


def archive_device(code: Column | str, prefix: str = "OLD") -> Column:
    """U1 for archives: what is not a letter, digit, or one of -_. becomes _; blank is OLD_USER; the prefix is joined by -."""
    safe = F.regexp_replace(norm_device(code), r"[^\p{L}\p{N}\-_.]", "_")
    return F.concat(F.lit(prefix if prefix.endswith(("-", "_")) else f"{prefix}-"), F.when(F.length(safe) == 0, "OLD_USER").otherwise(safe))


def norm_ext(ext: Column | str, name: Column | str | None = None) -> Column:
    """Trimmed, without leading dots, in lower case, behind one dot; blank stays blank, or is taken from the file name."""
    bare = F.lower(F.regexp_replace(F.trim(c(ext)), r"^\.+", ""))
    known = F.when(bare == "", "").otherwise(F.concat(F.lit("."), bare))
    if name is None:
        return known
    own = F.lower(F.regexp_extract(c(name), r"(\.[^.\\/]+)$", 1))
    return F.when(known == "", own).otherwise(known)


def norm_ext_catalogue(ext: Column | str) -> Column:
    """U2, catalogue form: trimmed, in lower case, a dot in front if there is none; further leading dots stay."""
    v = F.lower(F.trim(c(ext)))
    return F.when((v == "") | F.startswith(v, F.lit(".")), v).otherwise(F.concat(F.lit("."), v))


def norm_ext_list(exts: Column | str) -> Column:
    """U2, list form: the extensions of an array, normalised, distinct, sorted, blank ones left out."""
    return F.array_sort(F.array_distinct(F.filter(F.transform(c(exts), norm_ext), lambda e: e != "")))


def path_identity(path: Column | str) -> Column:
    """Slashes forward, none at the end, upper case."""
    return F.upper(F.regexp_replace(F.translate(F.trim(c(path)), "\\", "/"), "/+$", ""))


def user_folder(relative: Column | str) -> Column:
    """U4: the first folder of a relative path; _ROOT if it has none."""
    p = F.translate(c(relative), "\\", "/")
    return F.when(F.instr(p, "/") > 0, F.substring_index(p, "/", 1)).otherwise("_ROOT")


def below_user_folder(relative: Column | str) -> Column:
    """U4: what follows the first folder."""
    p = F.translate(c(relative), "\\", "/")
    return F.when(F.instr(p, "/") > 0, F.substring(p, F.instr(p, "/") + 1, F.length(p))).otherwise(p)


def ancestors(directory: Column | str, separator: str = "\\") -> Column:
    """U4: a directory and the directories above it, but not the drive, longest last."""
    parts = F.split(c(directory), r"\\" if separator == "\\" else separator)
    many = F.when(F.size(parts) >= 2, F.sequence(F.lit(2), F.size(parts))).otherwise(F.array().cast("array<int>"))
    return F.transform(many, lambda n: F.array_join(F.slice(parts, 1, n), separator))


def object_key(prefix: str, user: Column | str, relative: Column | str) -> Column:
    """prefix/user/segments; segments . and .. go, blank ones and control characters become _."""
    segments = F.filter(F.split(F.translate(c(relative), "\\", "/"), "/"), lambda s: ~s.isin(".", ".."))
    safe = F.transform(segments, lambda s: F.when(F.trim(s) == "", "_").otherwise(F.regexp_replace(s, r"[\x00-\x1F\x7F]", "_")))
    return F.concat_ws("/", F.lit(prefix), c(user), F.array_join(safe, "/"))


def hashed_object_key(device: Column | str, path: Column | str, name: Column | str, size: Column | str, modified_at: Column | str, sha256: Column | str) -> Column:
    """U5, hashed form: devices/code/hash of the path identity/hash of size:ticks:sha/name. Ticks are tenths of microseconds since the year 1."""
    code = F.regexp_replace(c(device), r"[^\p{L}\p{N}\-_.]", "_")
    ticks = F.unix_micros(c(modified_at).cast("timestamp")) * 10 + F.lit(621_355_968_000_000_000)
    revision = F.concat_ws(":", c(size).cast("string"), ticks.cast("string"), c(sha256))
    return F.concat_ws("/", F.lit("devices"), code, F.sha2(path_identity(path), 256), F.sha2(revision, 256), c(name))


def length_prefixed_sha256(*parts: Column | str) -> Column:
    """SHA-256 of len:value of each part; null counts as blank."""
    values = [F.coalesce(c(p).cast("string"), F.lit("")) for p in parts]
    return F.sha2(F.concat(*(x for v in values for x in (F.length(v).cast("string"), F.lit(":"), v))), 256)


def content_type(ext: Column | str) -> Column:
    """By extension, else octet-stream."""
    known = F.create_map(*(F.lit(x) for pair in CONTENT_TYPES.items() for x in pair))
    return F.coalesce(F.try_element_at(known, F.lower(c(ext))), F.lit(UNKNOWN_TYPE))


def to_utc(ts: Column | str, as_of: str) -> Column:
    """U8: a missing time is the load time."""
    return F.coalesce(c(ts), ntz(as_of))


def ntz(text: str) -> Column:
    return F.lit(text).cast("timestamp_ntz")


def human_size(n: Column | str) -> Column:
    """1024 steps from B to TB, one decimal at most and no trailing .0."""
    n = c(n)
    out = F.concat(n.cast("string"), F.lit(" B"))
    for power, unit in enumerate(("KB", "MB", "GB", "TB"), 1):
        tenths = F.floor(n.cast("double") / 1024**power * 10 + 0.5).cast("long")
        text = F.concat(F.floor(tenths / 10).cast("string"), F.when(tenths % 10 == 0, "").otherwise(F.concat(F.lit("."), (tenths % 10).cast("string"))), F.lit(f" {unit}"))
        out = F.when(n >= 1024**power, text).otherwise(out)
    return out


def version_parts(v: Column | str) -> Column:
    """2 to 4 numbers, missing ones -1; null if v is not of that form."""
    v = F.trim(c(v))
    parts = F.transform(F.split(v, r"\."), lambda x: x.cast("int"))
    return F.when(v.rlike(r"^\d{1,9}(\.\d{1,9}){1,3}$"), F.slice(F.concat(parts, F.array(*(F.lit(-1) for _ in range(4)))), 1, 4))


def version_status(v: Column | str, newest: Column | str) -> Column:
    """Latest, outdated, newer or unknown."""
    a, b = version_parts(v), version_parts(newest)
    return F.when(a.isNull() | b.isNull(), "unknown").when(a == b, "latest").when(a < b, "outdated").otherwise("newer")


def collapse_ws(text: Column | str) -> Column:
    """Runs of white space become one space."""
    return F.trim(F.regexp_replace(c(text), r"\s+", " "))


#: Bits of the types of U12; a column's bits are or-ed and read by merged_type.
TYPES = {"null": 0, "boolean": 1, "integer": 2, "number": 4, "date": 8, "datetime": 16, "string": 32}
_FORMS = (
    ("boolean", r"(?i)^(true|false)$"),
    ("integer", r"^[+-]?\d{1,18}$"),
    ("number", r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"),
    ("date", r"^(\d{4}-\d{2}-\d{2}|\d{1,2}/\d{1,2}/\d{4})$"),
    ("datetime", r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?Z?$"),
)


def infer_type(value: Column | str) -> Column:
    """The name of a value's type. Dates are yyyy-mm-dd or d/m/yyyy; a datetime is an ISO date with a time."""
    v = F.trim(c(value))
    out = F.when(v.isNull() | (v == ""), "null")
    for name, form in _FORMS:
        out = out.when(v.rlike(form), name)
    return out.otherwise("string")


def type_bits(value: Column | str) -> Column:
    kind = infer_type(value)
    out = F.lit(TYPES["string"])
    for name, bit in TYPES.items():
        out = F.when(kind == name, bit).otherwise(out)
    return out


def merged_type(bits: Column | str) -> Column:
    """The type of a column from the or of its values' bits: integer and number are number, date and datetime are datetime, other mixtures are string."""
    b = c(bits)
    out = F.when(b == 6, "number").when(b == 24, "datetime")
    for name, bit in TYPES.items():
        out = out.when(b == bit, name)
    return out.otherwise("string")


def column_name(i: Column | str) -> Column:
    """0 is A, 25 Z, 26 AA; up to three letters."""
    i = c(i)
    letter = lambda x: F.char((x % 26 + 65).cast("int"))
    two = F.concat(letter(F.floor(i / 26) - 1), letter(i))
    three = F.concat(letter(F.floor((i - 702) / 676)), letter(F.floor((i - 702) / 26) % 26), letter(i - 702))
    return F.when(i < 26, letter(i)).when(i < 702, two).otherwise(three)


def column_index(reference: Column | str) -> Column:
    """U13, inverse: the letters that a cell reference starts with, as a number from 0; -1 if there are none."""
    letters = F.upper(F.regexp_extract(c(reference), "^[A-Za-z]+", 0))
    return F.aggregate(F.filter(F.split(letters, ""), lambda x: x != ""), F.lit(0), lambda n, x: n * 26 + F.ascii(x) - 64) - 1


def contains_ci(text: Column | str, part: str) -> Column:
    """ILIKE %part% with part taken literally."""
    return F.contains(F.lower(c(text)), F.lit(part.lower()))


LOG_LINE = r"^(.*?) \| (.*?) \| Device=(.*?) \| RequestId=(.*?) \| Step=(.*?) \| (.*?)(?: \| Details=(.*))?$"


def parse_log_line(line: Column | str) -> list[Column]:
    """Ts, level, device, request_id, step, message, details of a log line; - is null, a blank level INFO, other blanks stay."""
    part = lambda n: F.nullif(F.regexp_extract(c(line), LOG_LINE, n), F.lit("-"))
    return [part(1).alias("ts"), norm_level(part(2)).alias("level"), *(part(n).alias(name) for n, name in enumerate(("device", "request_id", "step", "message", "details"), 3))]


def norm_level(level: Column | str) -> Column:
    """Trimmed, upper case, INFO if blank."""
    v = F.upper(F.trim(F.coalesce(c(level), F.lit(""))))
    return F.when(v == "", "INFO").otherwise(v)


def online(last_seen: Column | str, as_of: str, minutes: int = 2) -> Column:
    """U16: seen strictly after minutes before as_of; never seen is offline."""
    return F.coalesce(c(last_seen) > ntz(as_of) - F.expr(f"interval {minutes} minutes"), F.lit(False))


def retry_delay(attempt: Column | str, base: int = 30, cap: int = 1800) -> Column:
    """Seconds: base doubled with each attempt after the first, cap at most."""
    return F.least(F.lit(base) * F.pow(F.lit(2.0), F.least(F.greatest(c(attempt) - 1, F.lit(0)), F.lit(30))), F.lit(float(cap))).cast("long")


def part_count(size: Column | str, part: Column | str) -> Column:
    """Parts of a size."""
    return F.ceil(c(size) / c(part)).cast("long")
