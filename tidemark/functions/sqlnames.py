"""The functions under SQL names.

``register`` creates the scalar functions and ``gapfill`` as SQL macros: no
Python at run time. A macro has one signature, so that the kinds of time have
names of their own; widths are text such as ``'15 minutes'`` or ``'3 months'``.

``sql`` also knows names that macros cannot express: ``first(value, at)``,
``last(value, at)``, ``histogram(value, low, high, n)``, ``locf(value) OVER (...)``,
and, in FROM, ``asof_join(left, right, keys, left_time, ...)`` and
``window_join(left, right, keys, left_time, value, before, ...)`` with queries as text.
"""

from __future__ import annotations

import ast
import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.functions.width import DAY
from tidemark.operators.joins import asof_join, window_join

_EPOCH = "TIMESTAMP_NTZ '1970-01-01 00:00:00'"
_DAYS = "TIMESTAMP_NTZ '2000-01-03 00:00:00'"
_MONTHS = "TIMESTAMP_NTZ '2000-01-01 00:00:00'"
_W = "CAST(width AS INTERVAL)"
#: The months and the microseconds of a width; both at once are refused.
_M = f"CAST(extract(YEARS FROM {_W}) * 12 + extract(MONTHS FROM {_W}) AS INT)"
_U = f"CAST((extract(DAYS FROM {_W}) * 86400 + extract(HOURS FROM {_W}) * 3600 + extract(MINUTES FROM {_W}) * 60 + extract(SECONDS FROM {_W})) * 1000000 AS BIGINT)"
_CALENDAR = f"({_M} > 0 OR {_U} % {DAY} = 0)"


def _checked(body: str, kind: str) -> str:
    bad = f"CAST(raise_error('a width is months or else days and time, and longer than zero') AS {kind})"
    return f"CASE WHEN ({_M} > 0) = ({_U} > 0) OR {_M} < 0 OR {_U} < 0 THEN {bad} ELSE {body} END"


def _back(ts: str, micros: str) -> str:
    return f"timestampadd(MICROSECOND, -({micros}), {ts})"


def _fixed(ts: str, origin: str) -> str:
    return _back(ts, f"pmod(timestampdiff(MICROSECOND, coalesce({origin}, {_DAYS}), {ts}), nullif({_U}, 0))")


def _ntz(ts: str, origin: str) -> str:
    o = f"coalesce({origin}, {_MONTHS})"
    k = f"CAST(floor((year({ts}) * 12 + month({ts}) - year({o}) * 12 - month({o})) / nullif({_M}, 0)) * {_M} AS INT)"
    start = lambda n: f"{o} + make_ym_interval(0, {n})"
    months = f"CASE WHEN {start(k)} > {ts} THEN {start(f'{k} - {_M}')} ELSE {start(k)} END"
    return f"CASE WHEN {_M} > 0 THEN {months} ELSE {_fixed(ts, origin)} END"


def _utc(ts: str) -> str:
    return f"timestampadd(MICROSECOND, unix_micros({ts}), {_EPOCH})"


def _instant(ts: str) -> str:
    return f"timestamp_micros(timestampdiff(MICROSECOND, {_EPOCH}, {ts}))"


#: Steps of the buckets by a zone's clock, each a function so that what it is given is worked out once.
_STEPS = {
    "tidemark_offset": ("(t TIMESTAMP_NTZ, zone STRING)", "BIGINT", "timestampdiff(MICROSECOND, t, convert_timezone('UTC', zone, t))"),
    "tidemark_valid": ("(c TIMESTAMP_NTZ, utc TIMESTAMP_NTZ, o BIGINT, zone STRING)", "TIMESTAMP_NTZ", "CASE WHEN c <= utc AND tidemark_offset(c, zone) = o THEN c END"),
    "tidemark_latest": (
        "(grid TIMESTAMP_NTZ, utc TIMESTAMP_NTZ, o BIGINT, u BIGINT, zone STRING)", "TIMESTAMP_NTZ",
        f"greatest({', '.join('tidemark_valid(' + _back('grid', f'{k} * u') + ', utc, o, zone)' for k in range(3))})",
    ),
    "tidemark_grid": ("(width STRING, utc TIMESTAMP_NTZ, o BIGINT, origin TIMESTAMP_NTZ)", "TIMESTAMP_NTZ", _back(f"bucket(width, {_back('utc', '-o')}, origin)", "o")),
    "tidemark_clock": (
        "(width STRING, utc TIMESTAMP_NTZ, o BIGINT, before BIGINT, zone STRING, origin TIMESTAMP_NTZ)", "TIMESTAMP_NTZ",
        f"greatest({', '.join(f'tidemark_latest(tidemark_grid(width, utc, {o}, origin), utc, {o}, {_U}, zone)' for o in ('o', 'before'))})",
    ),
    "tidemark_begun": (
        "(start TIMESTAMP_NTZ, here TIMESTAMP_NTZ, utc TIMESTAMP_NTZ, zone STRING)", "TIMESTAMP_NTZ",
        f"CASE WHEN convert_timezone(zone, 'UTC', start) > utc THEN {_back('utc', 'timestampdiff(MICROSECOND, start, here)')} ELSE convert_timezone(zone, 'UTC', start) END",
    ),
    "tidemark_calendar": ("(width STRING, here TIMESTAMP_NTZ, utc TIMESTAMP_NTZ, zone STRING, origin TIMESTAMP_NTZ)", "TIMESTAMP_NTZ", "tidemark_begun(bucket(width, here, origin), here, utc, zone)"),
    "tidemark_zoned": (
        "(width STRING, utc TIMESTAMP_NTZ, zone STRING, origin TIMESTAMP_NTZ)", "TIMESTAMP_NTZ",
        f"CASE WHEN {_CALENDAR} THEN tidemark_calendar(width, convert_timezone('UTC', zone, utc), utc, zone, origin) "
        f"ELSE tidemark_clock(width, utc, tidemark_offset(utc, zone), tidemark_offset({_back('utc', _U)}, zone), zone, origin) END",
    ),
}


def _date(origin: str) -> str:
    days = f"date_sub(d, CAST(pmod(datediff(d, coalesce({origin}, DATE '2000-01-03')), nullif({_U} div {DAY}, 0)) AS INT))"
    months = f"CAST({_ntz('CAST(d AS TIMESTAMP_NTZ)', f'CAST({origin} AS TIMESTAMP_NTZ)')} AS DATE)"
    refused = "CAST(raise_error('dates have buckets of whole days or months') AS DATE)"
    return f"CASE WHEN {_M} > 0 THEN {months} WHEN {_U} % {DAY} != 0 THEN {refused} ELSE {days} END"


FUNCTIONS = {
    "bucket": ("(width STRING, ts TIMESTAMP_NTZ, origin TIMESTAMP_NTZ DEFAULT NULL)", "TIMESTAMP_NTZ", _checked(_ntz("ts", "origin"), "TIMESTAMP_NTZ")),
    "bucket_utc": ("(width STRING, ts TIMESTAMP, origin TIMESTAMP DEFAULT NULL)", "TIMESTAMP", _checked(_instant(_ntz(_utc("ts"), _utc("origin"))), "TIMESTAMP")),
    "bucket_zone": ("(width STRING, ts TIMESTAMP, zone STRING, origin TIMESTAMP_NTZ DEFAULT NULL)", "TIMESTAMP", _instant(f"tidemark_zoned(width, {_utc('ts')}, zone, origin)")),
    "bucket_date": ("(width STRING, d DATE, origin DATE DEFAULT NULL)", "DATE", _checked(_date("origin"), "DATE")),
    "bucket_long": ("(width BIGINT, v BIGINT, origin BIGINT DEFAULT 0)", "BIGINT", "CASE WHEN width <= 0 THEN CAST(raise_error('a width is over zero') AS BIGINT) ELSE v - pmod(v - origin, nullif(width, 0)) END"),
}


def register(spark: SparkSession) -> list[str]:
    """Create the temporary functions. Returns their names."""
    first = {"bucket": FUNCTIONS["bucket"], **_STEPS, **FUNCTIONS}
    for name, (arguments, kind, body) in first.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}{arguments} RETURNS {kind} RETURN {body}")
    fixed = f"transform(sequence(0L, greatest(0L, timestampdiff(MICROSECOND, start, finish) div nullif({_U}, 0) + 1)), k -> timestampadd(MICROSECOND, k * {_U}, {_fixed('start', 'origin')}))"
    months = f"transform(sequence(0, greatest(0, CAST(months_between(finish, start) AS INT) div nullif({_M}, 0) + 2)), k -> coalesce(origin, {_MONTHS}) + make_ym_interval(0, CAST(k * {_M} + floor((year(start) * 12 + month(start) - year(coalesce(origin, {_MONTHS})) * 12 - month(coalesce(origin, {_MONTHS}))) / nullif({_M}, 0) - 1) * {_M} AS INT)))"
    whole = _checked(f"CASE WHEN {_M} > 0 THEN {months} ELSE {fixed} END", "ARRAY<TIMESTAMP_NTZ>")
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION gapfill(width STRING, start TIMESTAMP_NTZ, finish TIMESTAMP_NTZ, origin TIMESTAMP_NTZ DEFAULT NULL) RETURNS TABLE (bucket TIMESTAMP_NTZ) RETURN "
        f"SELECT b FROM (SELECT explode({whole}) AS b) WHERE b < finish AND b >= {_ntz('start', 'origin')}"
    )
    return [*FUNCTIONS, "gapfill"]


# --- names that macros cannot express -----------------------------------------------------------------------------


def _closing(text: str, at: int) -> int:
    """Where the parenthesis that opens at at is closed; quoted text does not count."""
    depth, quote = 0, ""
    for i in range(at, len(text)):
        c = text[i]
        if quote:
            quote = "" if c == quote else quote
        elif c in "'\"`":
            quote = c
        elif c in "([":
            depth += 1
        elif c in ")]":
            depth -= 1
            if not depth:
                return i
    raise ValueError("a parenthesis is not closed")


def arguments(text: str) -> list[str]:
    """The arguments of a call, at commas outside parentheses and quotes."""
    out, depth, quote = [""], 0, ""
    for c in text:
        if quote:
            quote = "" if c == quote else quote
        elif c in "'\"`":
            quote = c
        else:
            depth += (c in "([") - (c in ")]")
        if c == "," and not depth and not quote:
            out.append("")
        else:
            out[-1] += c
    return [x.strip() for x in out if x.strip()]


def _literal(text: str):
    """The Python value of a literal: text, a number, NULL, or ARRAY[...] of them."""
    inner = re.fullmatch(r"(?is)array\s*[\[(](.*)[\])]", text)
    if inner:
        return [_literal(x) for x in arguments(inner[1])]
    if re.fullmatch(r"(?i)null", text):
        return None
    quoted = re.fullmatch(r"(?is)(?:interval\s+)?'(.*)'", text)
    return quoted[1].replace("''", "'") if quoted else ast.literal_eval(text)


def _joined(spark: SparkSession, join: Callable[..., DataFrame], args: list[str]) -> str:
    plain, named = [], {}
    for x in args:
        m = re.match(r"(\w+)\s*=>\s*", x)
        if m:
            named[m[1]] = _literal(x[m.end() :])
        else:
            plain.append(_literal(x))
    for side in ("left_query", "right_query"):
        if side in named:
            plain.insert(0 if side == "left_query" else 1, named.pop(side))
    names = ["keys", "left_time", "within", "direction"] if join is asof_join else ["keys", "left_time", "value", "before", "after", "aggregate"]
    left, right = (sql(spark, q) for q in plain[:2])
    view = f"tidemark_{uuid.uuid4().hex}"
    join(left, right, **dict(zip(names, plain[2:])), **named).createOrReplaceTempView(view)
    return view


def _histogram(value: str, low: str, high: str, n: str) -> str:
    if not 1 <= int(n) <= 256 or not float(low) < float(high):
        raise ValueError("a histogram has 1 to 256 buckets between bounds in order")
    inside = f"least(greatest(CAST({n} * ((v - {low}) / ({high} - {low})) AS BIGINT) + 1, 1), {n})"
    slot = f"CASE WHEN v IS NULL THEN NULL WHEN isnan(v) OR v >= {high} THEN {n} + 1 WHEN v < {low} THEN 0 ELSE {inside} END".replace("v ", f"CAST({value} AS DOUBLE) ").replace("(v)", f"(CAST({value} AS DOUBLE))")
    return f"CASE WHEN count(1) > 0 THEN array({', '.join(f'count_if(({slot}) = {i})' for i in range(int(n) + 2))}) END"


_CALL = re.compile(r"(?i)'(?:[^']|'')*'|\"[^\"]*\"|`[^`]*`|--[^\n]*|\b(first|last|histogram|locf|asof_join|window_join)\s*\(")


def expand(spark: SparkSession, text: str) -> str:
    """text with the names above written out; joins become temporary views."""
    out, at = "", 0
    while m := _CALL.search(text, at):
        out += text[at : m.start()]
        if not m[1]:
            out, at = out + m[0], m.end()
            continue
        name, close = m[1].lower(), _closing(text, m.end() - 1)
        args, at = arguments(text[m.end() : close]), close + 1
        if name in ("asof_join", "window_join"):
            out += _joined(spark, asof_join if name == "asof_join" else window_join, args)
            continue
        args = [expand(spark, x) for x in args]
        if name == "histogram":
            out += _histogram(*args)
        elif name == "locf":
            over = re.compile(r"(?i)\s*over\s*\(").match(text, at)
            if not over:
                raise ValueError("locf needs OVER (...)")
            close = _closing(text, over.end() - 1)
            out += f"last_value({args[0]}) IGNORE NULLS OVER ({expand(spark, text[over.end() : close])} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
            at = close + 1
        elif len(args) == 2 and args[1].lower() not in ("true", "false"):
            out += f"{'min_by' if name == 'first' else 'max_by'}({', '.join(args)})"
        else:
            out += f"{m[1]}({', '.join(args)})"
    return out + text[at:]


def sql(spark: SparkSession, text: str) -> DataFrame:
    """Run a query that may use all of these names."""
    register(spark)
    return spark.sql(expand(spark, text))
