"""The problems' rules, row by row in plain Python, for small inputs."""

from __future__ import annotations

import json
import re
from collections import defaultdict
from datetime import datetime, timedelta, timezone

MONTHS = {m: i + 1 for i, m in enumerate("Jan Feb Mar Apr May Jun Jul Aug Sep Oct Nov Dec".split())}
EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)
NAMES = {"trace": "TRACE", "debug": "DEBUG", "info": "INFO", "log": "INFO", "notice": "INFO", "warn": "WARN", "warning": "WARN", "error": "ERROR", "err": "ERROR", "fatal": "FATAL", "critical": "FATAL", "crit": "FATAL", "panic": "FATAL", "alert": "FATAL", "emerg": "FATAL", "emergency": "FATAL"}


def micros(y, mo, d, h, mi, s, frac="", zone=""):
    t = datetime(int(y), int(mo), int(d), int(h), int(mi), int(s), tzinfo=timezone.utc)
    n = (t - EPOCH) // timedelta(microseconds=1) + int((frac + "000000")[:6])
    if zone not in ("", "Z", "UTC"):
        z = zone.replace(":", "")
        n -= (1 if z[0] == "+" else -1) * (int(z[1:3]) * 60 + int(z[3:5])) * 60_000_000
    return n


def iso(t):
    m = re.fullmatch(r"(\d{4})-(\d\d)-(\d\d)[T ](\d\d):(\d\d):(\d\d)(?:[.,](\d+))? ?(Z|UTC|[+-]\d\d:?\d\d)?", t)
    return micros(*m.groups()[:6], m[7] or "", m[8] or "")


def head(raw, year):
    t = re.sub(r"\x1b\[[0-9;]*m", "", raw)
    if m := re.match(r"(\d{4}-\d\d-\d\dT\S+) +(TRACE|DEBUG|INFO|WARN|ERROR) ([\w:]+): ", t):
        return iso(m[1]), NAMES[m[2].lower()], m[3]
    if m := re.match(r"[\d.]+ \S+ \S+ \[(\d\d)/(\w{3})/(\d{4}):(\d\d):(\d\d):(\d\d) ([+-]\d{4})\] \"", t):
        return micros(m[3], MONTHS[m[2]], m[1], m[4], m[5], m[6], "", m[7]), "", ""
    if m := re.match(r"\[(\d{4}-\d\d-\d\d \S+)\] \[(\w+)\] \[([^\]]+)\] ", t):
        return iso(m[1]), NAMES[m[2].lower()], m[3]
    if m := re.match(r"(\d{4}-\d\d-\d\d \S+ UTC) \[\d+\] (\w+):  ", t):
        return iso(m[1]), NAMES[m[2].lower()], ""
    if m := re.match(r"(\d{4}-\d\d-\d\d [\d:]+,\d{3}) (\w+) +\[[^\]]+\] (\S+) - ", t):
        return iso(m[1]), NAMES[m[2].lower()], m[3]
    if m := re.match(r"(\d{4}-\d\d-\d\d [\d:]+,\d{3}) - (\S+) - (\w+) - ", t):
        return iso(m[1]), NAMES[m[3].lower()], m[2]
    if m := re.match(r"<(\d+)>1 (\S+) \S+ (\S+) \S+ \S+ (?:-|\[)", t):
        return iso(m[2]), ["FATAL", "FATAL", "FATAL", "ERROR", "WARN", "INFO", "INFO", "DEBUG"][int(m[1]) % 8], m[3]
    if m := re.match(r"([A-Z][a-z]{2}) ([ \d]\d) (\d\d):(\d\d):(\d\d) \S+ ([\w.\-]+)(?:\[\d+\])?: ", t):
        return micros(year, MONTHS[m[1]], m[2], m[3], m[4], m[5]), "", m[6]
    if m := re.match(r"(\d{4})/(\d\d)/(\d\d) (\d\d):(\d\d):(\d\d) \[(\w+)\] \d+#\d+: ", t):
        return micros(*m.groups()[:6]), NAMES[m[7]], ""
    if m := re.match(r"([IWEF])(\d\d)(\d\d) (\d\d):(\d\d):(\d\d)\.(\d{6}) +\d+ ([\w.]+):\d+\] ", t):
        return micros(year, *m.groups()[1:6], m[7]), {"I": "INFO", "W": "WARN", "E": "ERROR", "F": "FATAL"}[m[1]], m[8]
    if t.startswith("{"):
        try:
            o = json.loads(t, parse_float=str, parse_int=str)
        except ValueError:
            return None
        when = o.get("time") or o.get("ts") or o.get("timestamp")
        if when is None:
            return None
        if "-" in when:
            n = iso(when)
        elif "." in when:
            a, b = when.split(".")
            n = int(a) * 1_000_000 + int((b + "000000")[:6])
        else:
            n = int(when) * 1000
        return n, NAMES[(o.get("level") or o.get("severity")).lower()], o.get("component") or o.get("logger")
    if re.fullmatch(r'\w+=("[^"]*"|\S*)( \w+=("[^"]*"|\S*))*', t):
        o = dict(re.findall(r'(\w+)=("[^"]*"|\S*)', t))
        when = o.get("time") or o.get("ts")
        if when:
            return iso(when), NAMES[(o.get("level") or o.get("lvl")).lower()], o.get("component") or o.get("logger")
    return None


def entries(rows):
    """rows: (event_id, event_time, host, source, line_no, raw)."""
    once = {}
    for r in sorted(rows):
        once.setdefault((r[2], r[3], r[4]), r)
    groups = defaultdict(list)
    for r in once.values():
        groups[r[2], r[3]].append(r)
    out = []
    for lines in groups.values():
        now = None
        for r in sorted(lines, key=lambda r: r[4]):
            h = head(r[5] or "", r[1].year)
            if h:
                now = [r[0], *h, 1]
                out.append(now)
            elif now:
                now[4] += 1
    return sorted(map(tuple, out))


def kind(v):
    return "null" if v is None else {bool: "boolean", int: "integer", float: "number", str: "string", dict: "object", list: "array"}[type(v)]


def changes(files):
    """files: (file_id, series, written_at, body)."""
    series = defaultdict(list)
    for r in files:
        series[r[1]].append((r[2], r[0], json.loads(r[3])))
    out = []
    for rows in series.values():
        kept: dict = {}
        before = None
        for _, file_id, now in sorted(rows, key=lambda r: r[:2]):
            types: dict = {}

            def note(o, path):
                for k, v in o.items():
                    p = f"{path}/{k}" if path else k
                    types[p] = kept.get(p, "null") if v is None else kind(v)  # noqa: B023
                    if isinstance(v, dict):
                        note(v, p)

            note(now, "")

            def compare(a, b, path):
                same = lambda x, y: json.dumps(x, sort_keys=True) == json.dumps(y, sort_keys=True)
                at = lambda k: f"{path}/{k}" if path else k
                gone, came = sorted(k for k in a if k not in b), sorted(k for k in b if k not in a)
                for g in list(gone):
                    for c in list(came):
                        if same(a[g], b[c]):
                            out.append((file_id, at(g), at(c), "renamed"))  # noqa: B023
                            gone.remove(g)
                            came.remove(c)
                            break
                out.extend((file_id, at(g), "", "removed") for g in gone)  # noqa: B023
                out.extend((file_id, "", at(c), "added") for c in came)  # noqa: B023
                for k in a:
                    if k in b:
                        old, new = kept.get(at(k), "null"), kind(b[k])  # noqa: B023
                        if "null" not in (old, new) and old != new:
                            out.append((file_id, at(k), at(k), "type_changed"))  # noqa: B023
                        elif isinstance(a[k], dict) and isinstance(b[k], dict):
                            compare(a[k], b[k], at(k))

            if before is not None:
                compare(before, now, "")
            before, kept = now, types
    return sorted(out)
