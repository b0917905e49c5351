"""Search and attribute functions over log text.

Each is a Column expression of built-in functions, so Catalyst inlines it; :func:`register` gives
SQL the same functions as temporary SQL functions. A null cell never matches (false, not null); a
null query and a query without a token are errors.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

# Fixed values of the default tokenizer.
MIN_TOKEN, MAX_TOKENS = 3, 64
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _ascii_lower(text: Column) -> Column:
    return F.translate(text, _UPPER, _LOWER)


def tokens(text: Column) -> Column:
    """The default tokenizer: runs of ASCII letters and digits of 3 and more, the first 64, lower
    case. Split before lowering: lowering other letters could make ASCII ones."""
    found = F.regexp_extract_all(text, F.lit(f"[A-Za-z0-9]{{{MIN_TOKEN},}}"), F.lit(0))
    return F.transform(F.slice(found, 1, MAX_TOKENS), _ascii_lower)


def raw_tokens(text: Column) -> Column:
    """The raw tokenizer: the whole value as one token."""
    return F.array(_ascii_lower(text))


def stem(token: Column) -> Column:
    """A token without one of the endings ing, ed, es, s, if enough of it is left."""
    cut = lambda n: F.substring(token, F.lit(1), F.length(token) - n)
    vowel = lambda c: c.rlike("[aeiou]")
    return (
        F.when(token.endswith("ing") & (F.length(token) >= 7) & vowel(cut(3)), cut(3))
        .when(token.endswith("ed") & (F.length(token) >= 5) & vowel(cut(2)), cut(2))
        .when(token.endswith("es") & (F.length(token) >= 5), cut(2))
        .when(token.endswith("s") & ~token.endswith("ss") & (F.length(token) >= 4), cut(1))
        .otherwise(token)
    )


def stem_tokens(text: Column) -> Column:
    return F.filter(F.transform(tokens(text), stem), lambda t: F.length(t) >= MIN_TOKEN)


def python_tokens(text: str) -> list[str]:
    """The default tokenizer for a query known when the plan is made."""
    return [t.lower() for t in re.findall(rf"[A-Za-z0-9]{{{MIN_TOKEN},}}", text)[:MAX_TOKENS]]


def _query(query: str | None) -> list[str]:
    if query is None:
        raise ValueError("a search query must not be null")
    found = python_tokens(query)
    if not found:
        raise ValueError(f"no token of {MIN_TOKEN} letters or digits in the query {query!r}")
    return found


def _array(words: list[str]) -> Column:
    return F.array(*[F.lit(w) for w in words])


def _false_for_null(test: Column) -> Column:
    return F.coalesce(test, F.lit(False))


def _holds(text: Column, words: list[str], every: bool) -> Column:
    """What a match can't do without: the words stand in the lower-case text. Tested first, so that
    few cells are split into tokens."""
    low = F.lower(text)
    tests = [low.contains(w) for w in words]
    out = tests[0]
    for t in tests[1:]:
        out = out & t if every else out | t
    return out


def match_terms(text: Column, query: str) -> Column:
    """Every token of the query is one of the cell's."""
    words = sorted(set(_query(query)))
    return _false_for_null(_holds(text, words, True) & (F.size(F.array_except(_array(words), tokens(text))) == 0))


match = match_terms


def match_any(text: Column, query: str) -> Column:
    words = sorted(set(_query(query)))
    return _false_for_null(_holds(text, words, False) & F.arrays_overlap(_array(words), tokens(text)))


def match_phrase(text: Column, query: str) -> Column:
    """The query's tokens follow one another among the cell's tokens; shorter words in between
    don't count."""
    words = _query(query)
    n = len(words)

    def within(cell: Column) -> Column:
        spots = F.sequence(F.lit(1), F.size(cell) - n + 1)
        return F.when(F.size(cell) >= n, F.exists(spots, lambda i: F.slice(cell, i, n) == _array(words)))

    # an array of one list of tokens: split once, not once for each place
    return _false_for_null(_holds(text, sorted(set(words)), True) & F.exists(F.array(tokens(text)), within))


def match_prefix(text: Column, query: str) -> Column:
    """Some token of the cell begins with some token of the query."""
    words = sorted(set(_query(query)))
    return _false_for_null(_holds(text, words, False) & F.exists(tokens(text), lambda t: _any([t.startswith(w) for w in words])))


def _any(tests: list[Column]) -> Column:
    out = tests[0]
    for t in tests[1:]:
        out = out | t
    return out


def kv_extract(text: Column, key: str | None) -> Column:
    """The value after ``key=``: a quoted one, or up to a blank or comma; null if there is none."""
    if key is None:
        return F.lit(None).cast("string")
    # Fixed value: the pattern of a key and its value.
    pattern = r'(?:^|[^A-Za-z0-9_])\Q' + key.replace(r"\E", r"\E\\E\Q") + r'\E=(?:"([^"]*)"|([^\s,]+))'
    quoted, bare = F.regexp_extract(text, pattern, 1), F.regexp_extract(text, pattern, 2)
    return F.when(text.rlike(pattern), F.when(bare != "", bare).otherwise(quoted))


def _member(name: str) -> str:
    return f"$.{name}" if "'" in name else f"$['{name}']"  # a quote can't be written within brackets


def attr_get(json: Column, key: str | None) -> Column:
    """The attribute's text. At each level a member named like the whole rest of the key wins, else
    the first part of the key is descended into; what is found is final. Strings as they are, numbers
    and booleans as written, objects and arrays as JSON; null for JSON null, malformed or no object.
    """
    if key is None:
        return F.lit(None).cast("string")
    here = F.json_object_keys(json)
    literal = F.get_json_object(json, _member(key))
    if "." not in key:
        return F.when(F.array_contains(here, key), literal)
    head, rest = key.split(".", 1)
    inner = F.get_json_object(json, _member(head))
    return F.when(F.array_contains(here, key), literal).otherwise(F.when(F.array_contains(here, head), attr_get(inner, rest)))


def epoch_micros(number: Column) -> Column:
    """Micros since 1970 of a number of nanoseconds (15 digits and more), milliseconds (11 and
    more) or seconds, rounded down."""
    n = number.cast("decimal(38,9)")
    return F.floor(F.when(F.abs(n) >= 10**15, n / 1000).when(F.abs(n) >= 10**11, n * 1000).otherwise(n * 1000000)).cast("long")


def nanos_to_micros(nanos: Column) -> Column:
    """Rounded down, also before 1970, in whole numbers."""
    return F.call_function("div", nanos - F.pmod(nanos, F.lit(1000)), F.lit(1000))


def date_bin(width_us: int, time: Column, origin_us: int = 0) -> Column:
    """The start of the time's bin; bins lie around the origin, also before it."""
    if width_us <= 0:
        raise ValueError("a bin must be wider than nothing")
    micros = F.unix_micros(time.cast("timestamp"))
    return F.timestamp_micros(micros - F.pmod(micros - F.lit(origin_us), F.lit(width_us)))


_SQL = {
    "log_tokens": ("text STRING", "ARRAY<STRING>", rf"transform(slice(regexp_extract_all(text, '[A-Za-z0-9]{{{MIN_TOKEN},}}', 0), 1, {MAX_TOKENS}), t -> translate(t, '{_UPPER}', '{_LOWER}'))"),
    "query_tokens": ("q STRING", "ARRAY<STRING>", "CASE WHEN q IS NULL THEN raise_error('a search query must not be null') WHEN size(log_tokens(q)) = 0 THEN raise_error('no token in the query') ELSE log_tokens(q) END"),
    "match_terms": ("text STRING, q STRING", "BOOLEAN", "coalesce(size(array_except(query_tokens(q), log_tokens(text))) = 0 AND text IS NOT NULL, false)"),
    "match": ("text STRING, q STRING", "BOOLEAN", "match_terms(text, q)"),
    "match_any": ("text STRING, q STRING", "BOOLEAN", "coalesce(arrays_overlap(query_tokens(q), log_tokens(text)), false)"),
    "match_phrase": ("text STRING, q STRING", "BOOLEAN", "coalesce(exists(array(struct(log_tokens(text) AS c, query_tokens(q) AS w)), x -> CASE WHEN size(x.c) >= size(x.w) THEN exists(sequence(1, size(x.c) - size(x.w) + 1), i -> slice(x.c, i, size(x.w)) = x.w) END), false)"),
    "match_prefix": ("text STRING, q STRING", "BOOLEAN", "coalesce(exists(log_tokens(text), t -> exists(query_tokens(q), w -> startswith(t, w))), false)"),
    "kv_extract": ("text STRING, k STRING", "STRING", r"""CASE WHEN text RLIKE concat('(?:^|[^A-Za-z0-9_])\\Q', k, '\\E=(?:"([^"]*)"|([^\\s,]+))') THEN
        CASE WHEN regexp_extract(text, concat('(?:^|[^A-Za-z0-9_])\\Q', k, '\\E=(?:"([^"]*)"|([^\\s,]+))'), 2) <> '' THEN regexp_extract(text, concat('(?:^|[^A-Za-z0-9_])\\Q', k, '\\E=(?:"([^"]*)"|([^\\s,]+))'), 2)
        ELSE regexp_extract(text, concat('(?:^|[^A-Za-z0-9_])\\Q', k, '\\E=(?:"([^"]*)"|([^\\s,]+))'), 1) END END"""),
    "date_bin": ("width INTERVAL DAY TO SECOND, t TIMESTAMP, origin TIMESTAMP DEFAULT TIMESTAMP '1970-01-01 00:00:00Z'", "TIMESTAMP", "timestamp_micros(unix_micros(t) - pmod(unix_micros(t) - unix_micros(origin), CAST(extract(SECOND FROM width) * 1000000 AS BIGINT) + 60000000L * (extract(MINUTE FROM width) + 60 * (extract(HOUR FROM width) + 24 * extract(DAY FROM width)))))"),
    "epoch_micros": ("n DECIMAL(38,9)", "BIGINT", "CAST(floor(CASE WHEN abs(n) >= 1000000000000000 THEN n / 1000 WHEN abs(n) >= 100000000000 THEN n * 1000 ELSE n * 1000000 END) AS BIGINT)"),
}


_AT = "if(locate('''', {0}) > 0, concat('$.', {0}), concat('$[''', {0}, ''']'))"
_STATE = "named_struct('doc', {0}, 'rest', {1}, 'done', {2}, 'out', {3})"
_NONE = "CAST(NULL AS STRING)"
_HEAD = "substring_index(s.rest, '.', 1)"
# keys known only when the query runs, of any depth: the document is folded along the key's parts
_ATTR = f"""CASE WHEN k IS NOT NULL THEN aggregate(split(k, '[.]'), {_STATE.format("j", "k", "false", _NONE)}, (s, part) -> CASE WHEN s.done THEN s
    WHEN array_contains(json_object_keys(s.doc), s.rest) THEN {_STATE.format("s.doc", "s.rest", "true", f"get_json_object(s.doc, {_AT.format('s.rest')})")}
    WHEN locate('.', s.rest) > 0 AND array_contains(json_object_keys(s.doc), {_HEAD}) THEN {_STATE.format(f"get_json_object(s.doc, {_AT.format(_HEAD)})", "substring(s.rest, locate('.', s.rest) + 1)", "false", _NONE)}
    ELSE {_STATE.format("s.doc", "s.rest", "true", _NONE)} END, s -> s.out) END"""


def register(spark: SparkSession) -> None:
    """Creates the functions as temporary SQL functions of the session."""
    for name, (arguments, result, body) in _SQL.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS {result} RETURN {body}")
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION attr_get(j STRING, k STRING) RETURNS STRING RETURN {_ATTR}")
    spark.sql("""CREATE OR REPLACE TEMPORARY FUNCTION generate_series(first BIGINT, last BIGINT, step BIGINT DEFAULT 1) RETURNS TABLE (value BIGINT)
      RETURN SELECT explode(CASE WHEN step > 0 AND first <= last OR step < 0 AND first >= last THEN sequence(first, last, step) WHEN step = 0 THEN raise_error('a series needs a step') END)""")
