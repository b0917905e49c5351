"""Log lines of programs with differing layouts into timestamp, level, component and message.

A line that, from its first character, follows a layout with a time of its own begins an entry;
the lines after it, in the order of line_no within host and source, belong to it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamlog.plans import ordered, scratch

LINES_A_BLOCK = 8192

# Level names, upper case, and what they count as.
LEVELS = {
    "TRACE": "TRACE", "DEBUG": "DEBUG", "INFO": "INFO", "LOG": "INFO", "NOTICE": "INFO", "INFORMATION": "INFO",
    "WARN": "WARN", "WARNING": "WARN", "ERROR": "ERROR", "ERR": "ERROR",
    "FATAL": "FATAL", "CRITICAL": "FATAL", "CRIT": "FATAL", "PANIC": "FATAL", "ALERT": "FATAL", "EMERGENCY": "FATAL", "EMERG": "FATAL",
    "I": "INFO", "W": "WARN", "E": "ERROR", "F": "FATAL",
}
SEVERITIES = ["FATAL", "FATAL", "FATAL", "ERROR", "WARN", "INFO", "INFO", "DEBUG"]
MONTHS = "JanFebMarAprMayJunJulAugSepOctNovDec"
COLOUR = r"\x1b\[[0-9;]*m"

_DATE, _CLOCK, _ZONE = r"\d{4}-\d\d-\d\d", r"\d\d:\d\d:\d\d", r"(?:Z|[+-]\d\d:?\d\d)"
_WORD = "(?i:" + "|".join(sorted((k for k in LEVELS if len(k) > 1), key=len, reverse=True)) + ")"
_PAIR = r'[A-Za-z_][\w.\-]*=(?:"(?:[^"\\]|\\.)*"|[^\s"]*)'


@dataclass(frozen=True)
class Layout:
    """``pattern``: what the line begins with. ``time``, ``level``, ``component``: group numbers,
    0 for none."""

    name: str
    pattern: str
    time: int
    level: int = 0
    component: int = 0
    kind: str = "iso"


# The layouts' patterns.
LAYOUTS = [
    Layout("tracing", rf"({_DATE}T{_CLOCK}(?:\.\d+)?{_ZONE}) +({_WORD}) ([\w:.\-]+): ", 1, 2, 3),
    Layout("access", rf"[0-9A-Fa-f.:]+ \S+ \S+ \[(\d\d/[A-Z][a-z][a-z]/\d{{4}}:{_CLOCK} [+-]\d{{4}})\] \"", 1, kind="access"),
    Layout("bracketed", rf"\[({_DATE} {_CLOCK}(?:[.,]\d+)?)\] \[({_WORD})\] \[([^\]]+)\] ", 1, 2, 3),
    Layout("server", rf"({_DATE} {_CLOCK}(?:\.\d+)? [A-Z][A-Za-z/_]*) \[\d+\] ({_WORD}):  ?", 1, 2),
    Layout("logger", rf"({_DATE} {_CLOCK},\d{{3}}) ({_WORD}) +\[[^\]]*\] (\S+) - ", 1, 2, 3),
    Layout("dashed", rf"({_DATE} {_CLOCK},\d{{3}}) - (\S+) - ({_WORD}) - ", 1, 3, 2),
    Layout("syslog", rf"<(\d{{1,3}})>1 ({_DATE}T{_CLOCK}(?:\.\d+)?{_ZONE}) \S+ (\S+) \S+ \S+ (?:-|(?:\[(?:[^\]\"]|\"(?:[^\"\\]|\\.)*\")*\])+)(?= |$)", 2, 1, 3, kind="syslog"),
    Layout("bsd", rf"(?:<(\d{{1,3}})>)?([A-Z][a-z][a-z] [ \d]\d {_CLOCK}) \S+ ([^\s:\[\]]+)(?:\[\d+\])?: ", 2, 1, 3, kind="bsd"),
    Layout("proxy", rf"(\d{{4}}/\d\d/\d\d {_CLOCK}) \[({_WORD})\] \d+#\d+: ", 1, 2, kind="slashed"),
    Layout("glog", r"([IWEF])(\d{4} \d\d:\d\d:\d\d\.\d+) +\d+ ([^\s:\]]+):\d+\] ", 2, 1, 3, kind="glog"),
]
# with members or pairs in any order: the whole line is read
TIME_KEYS, LEVEL_KEYS, COMPONENT_KEYS, TEXT_KEYS = ["time", "ts", "timestamp", "@timestamp"], ["level", "lvl", "severity"], ["component", "logger", "target"], ["message", "msg"]


def _level(text: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in LEVELS.items() for x in pair])
    return F.coalesce(F.try_element_at(table, F.upper(text)), F.lit(""))


def _severity(priority: Column) -> Column:
    table = F.array(*[F.lit(s) for s in SEVERITIES])
    return F.when(priority == "", "").otherwise(F.element_at(table, (F.coalesce(priority.try_cast("int"), F.lit(0)) % 8 + 1).cast("int")))


def _epoch(text: Column) -> Column:
    """Micros of a number of seconds, milli-, micro- or nanoseconds since 1970, by its size."""
    n = text.try_cast("decimal(38,9)")
    return F.floor(F.when(F.abs(n) >= 10**17, n / 1000).when(F.abs(n) >= 10**14, n).when(F.abs(n) >= 10**11, n * 1000).otherwise(n * 1000000)).cast("long")


def _month(name: Column) -> Column:
    """Two digits; 00 for what is no month."""
    return F.lpad(F.floor((F.instr(F.lit(MONTHS), name) + 2) / 3).cast("string"), 2, "0")


def _micros(kind: str, text: Column, received: Column) -> Column:
    """Micros of a time as a layout writes it, put into ISO order first; null if it doesn't exist."""
    if kind in ("iso", "syslog"):
        iso = F.replace(text, F.lit(","), F.lit("."))
    elif kind == "access":  # 01/Mar/2026:10:00:00 +0000
        iso = F.concat(text.substr(8, 4), F.lit("-"), _month(text.substr(4, 3)), F.lit("-"), text.substr(1, 2), F.lit("T"), text.substr(13, 8), text.substr(22, 3), F.lit(":"), text.substr(25, 2))
    elif kind == "slashed":
        iso = F.replace(text, F.lit("/"), F.lit("-"))
    else:
        year = F.date_format(received, "yyyy")
        if kind == "bsd":  # Mar  1 10:00:00
            iso = F.concat(year, F.lit("-"), _month(text.substr(1, 3)), F.lit("-"), F.lpad(F.trim(text.substr(5, 2)), 2, "0"), F.lit("T"), text.substr(8, 8))
        else:  # month, day and a clock with a fraction of any length
            iso = F.concat(year, F.lit("-"), text.substr(1, 2), F.lit("-"), text.substr(3, 2), text.substr(5, 40))
    return F.unix_micros(iso.try_cast("timestamp"))


def _first_json(text: Column, keys: list[str]) -> Column:
    return F.coalesce(*[F.get_json_object(text, f"$['{k}']") for k in keys])


def _first_member(value: Column, keys: list[str]) -> Column:
    return F.coalesce(*[F.try_variant_get(value, f"$['{k}']", "string") for k in keys])


def _first_pair(text: Column, keys: list[str]) -> Column:
    found = F.regexp_extract(text, rf'(?:^| )(?:{"|".join(keys)})=("(?:[^"\\]|\\.)*"|[^\s"]*)', 1)
    return F.regexp_replace(found, '^"|"$', "")


def _choose(cases: list[tuple[Column, Column]]) -> Column:
    out = None
    for test, value in cases:
        out = F.when(test, value) if out is None else out.when(test, value)
    return out


def parsed(df: DataFrame) -> DataFrame:
    """Adds ``head``, struct(layout, ts_us, level, component, skip), to lines with raw and event_time:
    null for a line that begins no entry. ``skip``: characters (colour codes removed) before the
    message; -1 if it is a member's value.

    In steps, each of which is computed once: the text, its layout, the layout's groups, what they
    mean.
    """
    raw = F.coalesce("raw", F.lit(""))
    rows = df.withColumn("__text", F.when(F.contains(raw, F.lit("\x1b")), F.regexp_replace(raw, COLOUR, "")).otherwise(raw))
    text, none = F.col("__text"), F.lit("")
    rows = rows.withColumn("__json", F.when(text.startswith("{"), F.try_parse_json(text)))
    layout = _choose([(text.rlike("^" + lay.pattern), F.lit(lay.name)) for lay in LAYOUTS])
    rows = rows.withColumn("__layout", layout.when(F.col("__json").isNotNull(), "json").when(text.rlike(rf"^{_PAIR}(?: +{_PAIR})*\s*$"), "pairs"))
    name = F.col("__layout")
    bare = F.regexp_replace(text, r'(^| )(msg|message)="(?:[^"\\]|\\.)*"', "$1$2=")
    rows = rows.withColumn("__bare", F.when(name == "pairs", bare))

    def part(of, keys: list[str]) -> Column:
        cases = [(name == lay.name, F.regexp_extract(text, "^" + lay.pattern, of(lay))) for lay in LAYOUTS if of(lay)]
        return _choose([*cases, (name == "json", _first_member(F.col("__json"), keys)), (name == "pairs", _first_pair(F.col("__bare"), keys))])

    rows = rows.withColumns({"__when": part(lambda x: x.time, TIME_KEYS), "__level": part(lambda x: x.level, LEVEL_KEYS), "__component": part(lambda x: x.component, COMPONENT_KEYS)})
    when, by_kind = F.col("__when"), {k: [lay.name for lay in LAYOUTS if lay.kind == k] for k in dict.fromkeys(lay.kind for lay in LAYOUTS)}
    free = F.coalesce(_epoch(when), F.unix_micros(when.try_cast("timestamp")))
    micros = _choose([*[(name.isin(names), _micros(kind, when, F.col("event_time"))) for kind, names in by_kind.items()], (name.isNotNull(), free)])
    priority = name.isin([lay.name for lay in LAYOUTS if lay.kind in ("syslog", "bsd")])
    component = F.when((name == "syslog") & (F.col("__component") == "-"), none).otherwise(F.coalesce("__component", none))
    skip = _choose([(name == lay.name, F.length(F.regexp_extract(text, "^" + lay.pattern, 0))) for lay in LAYOUTS]).otherwise(-1)
    head = F.struct(name.alias("layout"), F.col("__us").alias("ts_us"), F.when(priority, _severity(F.col("__level"))).otherwise(_level(F.coalesce("__level", none))).alias("level"), component.alias("component"), skip.alias("skip"))
    rows = rows.withColumn("__us", micros)
    return rows.withColumn("head", F.when(F.col("__us").isNotNull(), head)).drop("__text", "__json", "__layout", "__bare", "__when", "__level", "__component", "__us")


def _at() -> Column:
    # a line without a number stands after all others, each one for itself
    return F.coalesce("line_no", F.lit(1 << 62) + F.col("event_id"))


def once(df: DataFrame) -> DataFrame:
    """Each line once, of whatever layout: host, source, at, event_id, event_time, raw."""
    has = F.struct("event_id", "event_time", "raw")
    lines = df.select("host", "source", _at().alias("at"), "event_id", "event_time", "raw").groupBy("host", "source", "at").agg(F.min_by(has, "event_id").alias("x"))
    return lines.select("host", "source", "at", "x.*")


def _lines(df: DataFrame, text: bool) -> DataFrame:
    """Each line once, with its block and, if it begins an entry, its header. Lines are read before
    they are brought together: what is shuffled is what was read, and their texts only if wanted;
    copies of a line meet in their tasks first."""
    rows = parsed(df.select("host", "source", _at().alias("at"), "event_id", "event_time", "raw"))
    begin = F.when(F.col("head").isNotNull(), F.struct("at", "event_id", "head" if text else F.struct("head.ts_us", "head.level", "head.component").alias("head")))
    first = F.min(F.struct("event_id", begin.alias("begin"), *(["raw"] if text else [])))
    lines = rows.groupBy("host", "source", "at").agg(first.alias("x"))
    return lines.select("host", "source", "at", F.floor(F.col("at") / LINES_A_BLOCK).alias("block"), "x.event_id", *(["x.raw"] if text else []), "x.begin")


def assigned(df: DataFrame, text: bool = False) -> DataFrame:
    """Each line once with ``entry``: the line that begins the entry it belongs to (null: none)."""
    lines = scratch.materialise(_lines(df, text), "lines")
    return ordered.last_before(lines, ["host", "source"], ["at"], "block", "begin", "entry")


def entries(df: DataFrame, message: bool = True) -> DataFrame:
    """One row per entry: event_id, ts_us, level, component, n_rows and, unless turned off, layout
    and message (the first line's text after its header, and the entry's other lines).

    A line shipped twice counts once, with its smallest event_id; null hosts and sources are values
    like others; a null or empty line never begins an entry; a line with no entry before it is
    dropped; a line that looks like a layout but whose time doesn't exist begins none. The hottest
    host and source is split into blocks of lines, so its size doesn't matter; one single entry's
    lines come together when its message is asked for.
    """
    lines = assigned(df, message).where("entry is not null")
    keys = ["host", "source", F.col("entry.at").alias("first_at")]
    found = F.first("entry").alias("e")
    if not message:
        return lines.groupBy(*keys).agg(found, F.count("*").alias("n_rows")).select("e.event_id", "e.head.ts_us", "e.head.level", "e.head.component", "n_rows")
    plain = F.regexp_replace(F.coalesce("raw", F.lit("")), COLOUR, "")
    got = lines.withColumn("plain", plain).groupBy(*keys).agg(found, F.count("*").alias("n_rows"), F.transform(F.array_sort(F.collect_list(F.struct("at", "plain"))), lambda x: x["plain"]).alias("texts"))
    first, skip = F.element_at("texts", 1), F.col("e.head.skip")
    own = F.when(skip >= 0, F.substring(first, skip + 1, F.length(first))).when(F.col("e.head.layout") == "json", F.coalesce(_first_json(first, TEXT_KEYS), F.lit(""))).otherwise(_first_pair(first, TEXT_KEYS))
    rest = F.slice("texts", 2, F.size("texts"))
    return got.select("e.event_id", "e.head.ts_us", "e.head.level", "e.head.component", "n_rows", "e.head.layout", F.array_join(F.concat(F.array(F.ltrim(own)), rest), "\n").alias("message"))
