"""Scalar functions as Columns, and their driver-side parsers.  No Python runs on executors."""

from __future__ import annotations

import datetime as dt
import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Decimal and binary size units.
DECIMAL = {"": 1, "k": 10**3, "m": 10**6, "g": 10**9, "t": 10**12, "p": 10**15}
BINARY = {"ki": 2**10, "mi": 2**20, "gi": 2**30, "ti": 2**40, "pi": 2**50}
_SIZE = r"^\s*([0-9]+(?:\.[0-9]+)?)\s*([A-Za-z]*?)[Bb]?\s*$"


def as_column(x) -> Column:
    return x if isinstance(x, Column) else F.col(x)


# --- permissions and node types
def triplet(bits) -> Column:
    """rwx of three permission bits."""
    bits = as_column(bits)
    return F.concat(*[F.when(bits.bitwiseAND(b) != 0, c).otherwise("-") for b, c in ((4, "r"), (2, "w"), (1, "x"))])


def permissions(mode) -> Column:
    """Nine letters; question marks where the mode is missing."""
    mode = as_column(mode)
    return F.when(mode.isNull(), "?????????").otherwise(F.concat(*[triplet(F.shiftright(mode, s).bitwiseAND(7)) for s in (6, 3, 0)]))


def mode_string(node_type, mode) -> Column:
    kind = as_column(node_type)
    letter = F.when(kind == "dir", "d").when(kind == "symlink", "l").when(kind == "dev", "b").when(kind == "chardev", "c").when(kind == "fifo", "p").when(kind == "socket", "s").otherwise("-")
    return F.concat(letter, permissions(mode))


def is_executable(mode) -> Column:
    return as_column(mode).bitwiseAND(0o100) != 0


def link_string(node_type, target) -> Column:
    return F.when(as_column(node_type) == "symlink", F.concat(F.lit("-> "), as_column(target))).otherwise("")


def file_kind(node_type) -> Column:
    """The archive entry type of a node type."""
    kind = as_column(node_type)
    return F.when(kind == "dir", "directory").when(kind == "symlink", "symlink").when(kind == "dev", "block").when(kind == "chardev", "char").when(kind == "fifo", "fifo").otherwise("regular")


# --- sizes
def human_size(size) -> Column:
    """Binary units with one decimal: 512 B, 240.5 kiB, 1.0 MiB."""
    size = as_column(size).cast("long")
    out = F.concat(size.cast("string"), F.lit(" B"))
    for unit, f in (("kiB", 2**10), ("MiB", 2**20), ("GiB", 2**30), ("TiB", 2**40), ("PiB", 2**50)):
        whole, tenths = F.floor(size / f), F.floor((F.pmod(size, F.lit(f)) * 10 + f // 2) / f)  # integers: no rounding mode
        whole, tenths = F.when(tenths == 10, whole + 1).otherwise(whole), F.when(tenths == 10, 0).otherwise(tenths)
        out = F.when(size >= f, F.concat(whole.cast("string"), F.lit("."), tenths.cast("string"), F.lit(f" {unit}"))).otherwise(out)
    return out


def parse_size(text) -> Column:
    """Bytes of '10', '10k', '1MB', '1 GiB'; null if it is none."""
    text = as_column(text)
    unit = F.lower(F.regexp_extract(text, _SIZE, 2))
    factor = F.lit(None).cast("double")
    for u, f in (DECIMAL | BINARY).items():
        factor = F.when(unit == u, float(f)).otherwise(factor)
    return F.round(F.nullif(F.regexp_extract(text, _SIZE, 1), F.lit("")).cast("double") * factor).cast("long")


def size_of(text: str) -> int:
    m = re.match(_SIZE, text)
    units = DECIMAL | BINARY
    if not m or m[2].lower() not in units:
        raise ValueError(f"no size: {text!r}")
    return round(float(m[1]) * units[m[2].lower()])


@dataclass(frozen=True)
class SizeRange:
    """Inclusive bounds; either may be open.  A single size is a lower bound."""

    low: int | None = None
    high: int | None = None

    @classmethod
    def parse(cls, text: str) -> SizeRange:
        low, dots, high = text.partition("..")
        return cls(size_of(low) if low.strip() else None, size_of(high) if dots and high.strip() else None)

    def contains(self, size) -> Column:
        size, out = as_column(size), F.lit(True)
        if self.low is not None:
            out = out & (size >= self.low)
        if self.high is not None:
            out = out & (size <= self.high)
        return out

    def __str__(self) -> str:
        return f"{'' if self.low is None else self.low}..{'' if self.high is None else self.high}"


# --- times
def after_bound(text: str) -> dt.datetime:
    """A bound for 'after': a date without a time means the end of that day."""
    if re.fullmatch(r"\s*\d{4}-\d{2}-\d{2}\s*", text):
        return dt.datetime.combine(dt.date.fromisoformat(text.strip()), dt.time.max)
    return dt.datetime.fromisoformat(text.strip())


def before_bound(text: str) -> dt.datetime:
    return dt.datetime.fromisoformat(text.strip())


def epoch_seconds(time) -> Column:
    """Seconds as a float, in milliseconds precision."""
    return F.unix_millis(as_column(time).cast("timestamp")) / F.lit(1000.0)


def clock(seconds) -> Column:
    """hh:mm:ss."""
    s = as_column(seconds).cast("long")
    return F.format_string("%02d:%02d:%02d", F.floor(s / 3600), F.floor(F.pmod(s, F.lit(3600)) / 60), F.pmod(s, F.lit(60)))


def listing_time(time) -> Column:
    """' 8 Oct 2024 08:11', the day padded with a blank."""
    time = as_column(time)
    return F.concat(F.lpad(F.date_format(time, "d"), 2, " "), F.date_format(time, " MMM yyyy HH:mm"))


def format_time(time, zone, here: str, show_offset: bool = False) -> Column:
    """A stored instant with the zone it was taken in (an id or an offset like +02:00), as people at `here` read it: as it stands where both
    zones agree at that instant, else converted and marked by *; or, with show_offset, in its own zone with the offset."""
    time, zone = as_column(time).cast("timestamp"), zone if isinstance(zone, Column) else F.lit(zone)
    utc = F.to_utc_timestamp(time, F.current_timezone())
    own, local = F.from_utc_timestamp(utc, zone), F.from_utc_timestamp(utc, F.lit(here))
    text = lambda t: F.date_format(t.cast("timestamp_ntz"), "yyyy-MM-dd HH:mm:ss")
    minutes = F.timestamp_diff("MINUTE", utc, own)
    sign = F.when(minutes < 0, "-").otherwise("+")
    offset = F.concat(sign, F.format_string("%02d%02d", F.floor(F.abs(minutes) / 60).cast("int"), F.pmod(F.abs(minutes), F.lit(60)).cast("int")))
    return F.concat(text(own), offset) if show_offset else F.when(own == local, text(own)).otherwise(F.concat(text(local), F.lit("*")))


#: Units of durations, in seconds or months.
SECONDS = {"s": 1, "sec": 1, "secs": 1, "second": 1, "seconds": 1, "m": 60, "min": 60, "mins": 60, "minute": 60, "minutes": 60, "h": 3600, "hr": 3600, "hrs": 3600, "hour": 3600, "hours": 3600, "d": 86400, "day": 86400, "days": 86400,
           "w": 604800, "wk": 604800, "week": 604800, "weeks": 604800}
MONTHS = {"mo": 1, "mos": 1, "month": 1, "months": 1, "y": 12, "yr": 12, "yrs": 12, "year": 12, "years": 12}


def parse_duration(text: str) -> tuple[int, int]:
    """(months, seconds) of '2h30m', '3 days', '1 year 2 months'."""
    months = seconds = 0
    parts = re.findall(r"\s*(\d+)\s*([A-Za-z]+)[\s,]*", text)
    if not parts or re.sub(r"\s*(\d+)\s*([A-Za-z]+)[\s,]*", "", text):
        raise ValueError(f"no duration: {text!r}")
    for n, unit in parts:
        unit = unit if unit in SECONDS or unit in MONTHS else unit.lower()
        if unit in MONTHS:
            months += int(n) * MONTHS[unit]
        elif unit in SECONDS:
            seconds += int(n) * SECONDS[unit]
        else:
            raise ValueError(f"no unit of time: {unit!r}")
    return months, seconds


def interval(text: str) -> str:
    """A duration as the body of a SQL interval that is subtracted: months and seconds do not mix in one."""
    months, seconds = parse_duration(text)
    return f"{months} months - interval {seconds} seconds" if months and seconds else f"{months} months" if months else f"{seconds} seconds"


def duration_text(seconds) -> Column:
    """'2d 3h 4m 5s'; parts that are zero do not show."""
    s = F.floor(as_column(seconds)).cast("long")
    parts = [F.when(n > 0, F.concat(n.cast("string"), F.lit(u))) for n, u in ((F.floor(s / 86400), "d"), (F.floor(F.pmod(s, F.lit(86400)) / 3600), "h"), (F.floor(F.pmod(s, F.lit(3600)) / 60), "m"), (F.pmod(s, F.lit(60)), "s"))]
    return F.when(s == 0, "0s").otherwise(F.concat_ws(" ", *parts))


def option_field(name: str) -> str:
    """The field of an option or of an environment name: MY_DRY_RUN, --dry-run -> dry-run."""
    return name.removeprefix("--").lower().replace("_", "-")


def environment_name(option: str, prefix: str) -> str:
    """The environment name of an option: dry-run -> PREFIX_DRY_RUN."""
    return f"{prefix}_{option.removeprefix('--')}".upper().replace("-", "_")


# --- texts, lists and maps
def parse_labels(text) -> Column:
    """'k=v, k=v' as a map; raises where a part has no '='."""
    parts = F.filter(F.transform(F.split(as_column(text), ","), lambda x: F.trim(x)), lambda p: p != "")
    checked = F.transform(parts, lambda p: F.when(p.contains("="), p).otherwise(F.raise_error(F.concat(F.lit("label without '=': "), p)).cast("string")))
    return F.map_from_entries(F.transform(checked, lambda p: F.struct(F.trim(F.substring_index(p, "=", 1)).alias("k"), F.trim(F.regexp_replace(p, r"^[^=]*=", "")).alias("v"))))


def string_list(text) -> Column:
    return F.filter(F.transform(F.split(as_column(text), ","), lambda x: F.trim(x)), lambda p: p != "")


def url_base64(text) -> Column:
    """Base64 with the URL alphabet and no padding."""
    return F.rtrim(F.translate(F.base64(as_column(text).cast("binary")), "+/", "-_"), F.lit("="))


def short_id(column) -> Column:
    return F.substring(as_column(column), 1, 8)


def file_name(path) -> Column:
    return F.regexp_extract(as_column(path), r"([^/]*)$", 1)


def parent_path(path) -> Column:
    return F.regexp_replace(as_column(path), r"/[^/]*$", "")


def extension(path) -> Column:
    return F.regexp_extract(file_name(path), r"[^.]\.([^.]*)$", 1)


def percent(part, whole) -> Column:
    """'12.34'; null where the whole is zero."""
    share = F.try_divide(as_column(part) * 100.0, as_column(whole).cast("double"))
    return F.when(share.isNotNull(), F.format_string("%.2f", share))


def or_unknown(column, text: str = "?") -> Column:
    return F.coalesce(as_column(column).cast("string"), F.lit(text))


def delete_text(kind, after) -> Column:
    kind = as_column(kind)
    return F.when(kind == "never", "never").when(kind == "after", F.concat(F.lit("after "), as_column(after).cast("string"))).otherwise("not set")


def content_matches(content, blob_id) -> Column:
    return F.sha2(as_column(content).cast("binary"), 256) == as_column(blob_id)


# --- command-line forms
def snapshot_argument(text: str) -> tuple[str | None, str]:
    """(snapshot id, path) of 'id:path', (None, path) of a local path."""
    if text.startswith(("/", "\\", ".")):
        return None, text
    head, colon, tail = text.partition(":")
    if colon and head == "local":
        return None, tail
    return head, tail


def glob_regex(glob: str, ignore_case: bool = False, cross_separator: bool = True) -> str:
    """A regular expression for a shell glob with *, **, ?, [...] and {a,b}."""
    out, i, depth = "", 0, 0
    some, one = (".*", ".") if cross_separator else ("[^/]*", "[^/]")
    while i < len(glob):
        c = glob[i]
        if c == "*":
            double = glob[i:i + 2] == "**"
            if double and glob[i:i + 3] == "**/":
                out, i = out + "(?:.*/)?", i + 3
                continue
            out, i = out + (".*" if double else some), i + 1 + double
            continue
        if c == "?":
            out += one
        elif c == "[" and "]" in glob[i + 2:]:
            end = glob.index("]", i + 2)
            body = glob[i + 1:end]
            out += "[" + ("^" + body[1:] if body[0] in "!^" else body).replace("\\", "\\\\") + "]"
            i = end
        elif c == "{":
            out, depth = out + "(?:", depth + 1
        elif c == "}" and depth:
            out, depth = out + ")", depth - 1
        elif c == "," and depth:
            out += "|"
        else:
            out += re.escape(c)
        i += 1
    return ("(?is)" if ignore_case else "(?s)") + "^(?:" + out + ")$"
