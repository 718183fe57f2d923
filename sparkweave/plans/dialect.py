"""Rewrites the dialect's SQL into Spark SQL, token by token."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from sparkweave.functions.dates import interval_ms
from sparkweave.functions.predicates import glob_to_regex

_TOKEN = re.compile(
    r"""\s+ | --[^\n]* | /\*.*?\*/ | '(?:[^']|'')*' | "(?:[^"]|"")*" | `[^`]*` | \$\d+ | \d+\.\d*(?:[eE][+-]?\d+)? | \.\d+ | \d+(?:[eE][+-]?\d+)?
    | [^\W\d]\w* | ->> | -> | <=> | <> | != | <= | >= | \|\| | :: | .""",
    re.DOTALL | re.VERBOSE,
)


@dataclass(frozen=True)
class Token:
    text: str

    @property
    def word(self) -> str:
        """Upper case, for keywords."""
        return self.text.upper() if self.text[0].isalpha() or self.text[0] == "_" else self.text

    @property
    def is_name(self) -> bool:
        return self.text[0].isalpha() or self.text[0] in '_"`'

    @property
    def is_string(self) -> bool:
        return self.text[0] == "'"


class DialectError(ValueError):
    """A statement that the dialect does not have."""


def tokenize(sql: str) -> list[Token]:
    return [Token(m[0]) for m in _TOKEN.finditer(sql) if not m[0].isspace() and not m[0].startswith(("--", "/*"))]


def text_of(token: Token) -> str:
    """The value of a string literal."""
    return token.text[1:-1].replace("''", "'")


def quote(value: str) -> str:
    """A Spark string literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def name_of(token: Token) -> str:
    """An identifier; unquoted ones are in lower case."""
    return token.text[1:-1] if token.text[0] in '"`' else token.text.lower()


def closing(tokens: list[Token], at: int) -> int:
    """Position of the bracket that closes the one at ``at``."""
    depth = 0
    for i in range(at, len(tokens)):
        if tokens[i].text in "([":
            depth += 1
        elif tokens[i].text in ")]":
            depth -= 1
            if not depth:
                return i
    raise DialectError("unbalanced brackets")


def split_at(tokens: list[Token], separator: str = ",") -> list[list[Token]]:
    """Parts between separators outside brackets."""
    parts: list[list[Token]] = [[]]
    depth = 0
    for t in tokens:
        if t.text in "([":
            depth += 1
        elif t.text in ")]":
            depth -= 1
        if t.text == separator and not depth:
            parts.append([])
        else:
            parts[-1].append(t)
    return parts


def find(tokens: list[Token], *words: str, start: int = 0) -> int:
    """Position of a keyword outside brackets, or -1."""
    depth = 0
    for i in range(start, len(tokens)):
        if tokens[i].text in "([":
            depth += 1
        elif tokens[i].text in ")]":
            depth -= 1
        elif not depth and tokens[i].word in words:
            return i
    return -1


_PLAIN = {
    "UCASE": "upper", "LCASE": "lower", "LEN": "length", "ISNULL": "ifnull", "IIF": "if", "CEILING": "ceil", "POW": "power", "LOG": "ln",
    "GETDATE": "current_timestamp", "DAY": "dayofmonth", "DATE_TRUNC": "date_trunc", "CHARINDEX": "locate", "JSON_EXTRACT": "get_json_object",
    "JSON_EXTRACT_TEXT": "get_json_object", "STDDEV": "stddev_pop", "VARIANCE": "var_pop", "RANDOM": "rand", "DATABASE": "current_database", "MOD": "try_mod",
}

_UNITS = {"SECOND": 1000, "MINUTE": 60_000, "HOUR": 3_600_000, "DAY": 86_400_000, "WEEK": 604_800_000}


def _ms(x: str) -> str:
    return f"unix_millis(CAST({x} AS TIMESTAMP))"


def _date_add(ts: str, amount: str, unit: str, sign: str = "") -> str:
    unit = unit.strip("'\"").upper().rstrip("S") if unit.upper().strip("'\"") not in ("S",) else "SECOND"
    if unit in _UNITS:
        return f"timestamp_millis({_ms(ts)} + ({sign}({amount})) * {_UNITS[unit]})"
    if unit in ("MONTH", "QUARTER", "YEAR"):
        return f"(date_trunc('SECOND', {ts}) + make_ym_interval(0, CAST({sign}({amount}) * {dict(MONTH=1, QUARTER=3, YEAR=12)[unit]} AS INT)))"
    return ts


def _distance(metric: str, a: str, b: str) -> str:
    dot = lambda x, y: f"aggregate(zip_with({x}, {y}, (x, y) -> CAST(x AS DOUBLE) * CAST(y AS DOUBLE)), 0D, (s, x) -> s + x)"
    value = {
        "cosine": f"1 - try_divide({dot(a, b)}, sqrt({dot(a, a)}) * sqrt({dot(b, b)}))",
        "l2": f"sqrt(aggregate(zip_with({a}, {b}, (x, y) -> pow(CAST(x AS DOUBLE) - CAST(y AS DOUBLE), 2)), 0D, (s, x) -> s + x))",
        "dot": f"-{dot(a, b)}",
    }[metric]
    return f"CASE WHEN size({a}) = size({b}) THEN {value} ELSE 3.4028234663852886E38D END"


def _haversine(lat1: str, lng1: str, lat2: str, lng2: str) -> str:
    half = f"pow(sin(radians({lat2} - {lat1}) / 2), 2) + cos(radians({lat1})) * cos(radians({lat2})) * pow(sin(radians({lng2} - {lng1}) / 2), 2)"
    return f"(2 * 6371000.0D * asin(least(1D, sqrt({half}))))"


def _regexp_replace(args: list[str]) -> str:
    flags = args[3].strip("'") if len(args) > 3 else ""
    pattern = f"concat('(?i)', {args[1]})" if "i" in flags else args[1]
    if "g" in flags:
        return f"regexp_replace({args[0]}, {pattern}, {args[2]})"
    at, found = f"regexp_instr({args[0]}, {pattern})", f"regexp_substr({args[0]}, {pattern})"
    return f"CASE WHEN {at} > 0 THEN concat(substring({args[0]}, 1, {at} - 1), regexp_replace({found}, {pattern}, {args[2]}), substring({args[0]}, {at} + length({found}))) ELSE {args[0]} END"


def _truncate(x: str, digits: str = "0") -> str:
    return f"(signum({x}) * floor(abs({x}) * pow(10, {digits})) / pow(10, {digits}))"


def _substr(s: str, start: str, length: str | None = None) -> str:
    first = f"CASE WHEN {start} > 0 THEN {start} WHEN {start} = 0 THEN 1 ELSE greatest(length({s}) + {start} + 1, 1) END"
    return f"substring({s}, {first}, {f'greatest({length}, 0)' if length else f'length({s})'})"


def _week(ts: str) -> str:
    return f"CAST(floor((dayofyear({ts}) + dayofweek(trunc({ts}, 'YEAR')) - 2) / 7) AS INT)"


def _date_format(ts: str, template: str) -> str:
    from sparkweave.functions.dates import _FORMATS

    pieces = []
    for literal, letter in re.findall(r"([^%]+)|%(.)", template.strip("'")):
        pieces.append(quote(literal) if literal else f"lpad(CAST({_week(ts)} AS STRING), 2, '0')" if letter == "U" else f"CAST(dayofweek({ts}) - 1 AS STRING)" if letter == "w" else f"date_format({ts}, '{_FORMATS[letter]}')" if letter in _FORMATS else quote(letter))
    return f"concat({', '.join(pieces)})" if pieces else "''"


def _timestampdiff(unit: str, a: str, b: str) -> str:
    unit = unit.strip("'\"").upper()
    if unit == "YEAR":
        return f"(year({b}) - year({a}))"
    if unit in ("MONTH", "QUARTER"):
        months = f"((year({b}) - year({a})) * 12 + month({b}) - month({a}))"
        return months if unit == "MONTH" else f"({months} div 3)"
    return f"(({_ms(b)} - {_ms(a)}) div {_UNITS[unit]})"


def _as_json(value: str) -> str:
    """A scalar as JSON text; NULL is null."""
    wrapped = f"to_json(named_struct('v', {value}), map('ignoreNullFields', 'false'))"
    return f"substring({wrapped}, 6, length({wrapped}) - 6)"


def _listed(value: str, separator: str = "','") -> str:
    """Values as text, in the order of the values, so that runs agree; NULL for none."""
    gather = "collect_set" if value.startswith("DISTINCT ") else "collect_list"
    value = value.removeprefix("DISTINCT ")
    pairs = f"array_sort({gather}(CASE WHEN {value} IS NOT NULL THEN struct({value} AS k, CAST({value} AS STRING) AS v) END))"
    return f"nullif(array_join(transform({pairs}, x -> x.v), {separator}), CASE WHEN count({value}) = 0 THEN '' END)"


def _json_type(x: str) -> str:
    first = f"substring(ltrim({x}), 1, 1)"
    named = f"CASE {first} WHEN '{{' THEN 'object' WHEN '[' THEN 'array' WHEN '\"' THEN 'string' WHEN 't' THEN 'boolean' WHEN 'f' THEN 'boolean' WHEN 'n' THEN 'null' ELSE 'number' END"
    return f"CASE WHEN try_parse_json({x}) IS NOT NULL THEN {named} END"


_PARTS = {"YY": "year", "YEAR": "year", "MM": "month", "MONTH": "month", "DD": "dayofmonth", "DAY": "dayofmonth", "HH": "hour", "HOUR": "hour", "MI": "minute", "MINUTE": "minute", "SS": "second", "SECOND": "second", "QQ": "quarter", "QUARTER": "quarter", "DW": "dayofweek", "WEEKDAY": "dayofweek"}


def _datepart(part: str, ts: str) -> str:
    part = part.strip("'\"").upper()
    return _week(ts) if part in ("WK", "WEEK") else f"{_PARTS[part]}({ts})"


def _time_bucket(width: str, ts: str) -> str:
    w = interval_ms(width.strip("'"))
    return f"timestamp_millis({_ms(ts)} - pmod({_ms(ts)}, {w}))"


def _trunc(unit: str, ts: str) -> str:
    span = {"DECADE": 10, "CENTURY": 100}.get(unit.strip("'").upper())
    return f"make_timestamp(CAST(floor(year({ts}) / {span}) * {span} AS INT), 1, 1, 0, 0, 0)" if span else f"date_trunc({unit}, {ts})"


_CALLS: dict[str, Callable[[list[str]], str]] = {
    "CONCAT": lambda a: f"concat_ws('', {', '.join(a)})",
    "SUBSTR": lambda a: _substr(*a),
    "SUBSTRING": lambda a: _substr(*a),
    "TRIM": lambda a: f"regexp_replace({a[0]}, '(?U)^\\\\s+|\\\\s+$', '')",
    "LTRIM": lambda a: f"regexp_replace({a[0]}, '(?U)^\\\\s+', '')",
    "RTRIM": lambda a: f"regexp_replace({a[0]}, '(?U)\\\\s+$', '')",
    "REGEXP_REPLACE": _regexp_replace,
    "SPLIT_PART": lambda a: f"CASE WHEN {a[2]} > 0 THEN split_part({a[0]}, {a[1]}, greatest({a[2]}, 1)) ELSE '' END",
    "ASCII": lambda a: f"CASE WHEN length({a[0]}) > 0 THEN CAST(conv(hex(substring(encode({a[0]}, 'UTF-8'), 1, 1)), 16, 10) AS INT) END",
    "CHAR": lambda a: f"decode(unhex(lpad(hex(CAST({a[0]} AS BIGINT)), 8, '0')), 'UTF-32')",
    "SQRT": lambda a: f"CASE WHEN {a[0]} >= 0 THEN sqrt({a[0]}) END",
    "SIGN": lambda a: f"CAST(signum({a[0]}) AS INT)",
    "TRUNCATE": lambda a: _truncate(*a),
    "TRUNC": lambda a: _truncate(*a),
    "IF": lambda a: f"CASE WHEN coalesce(CAST(({a[0]}) AS BOOLEAN), FALSE) THEN {a[1]} ELSE {a[2]} END",
    "IIF": lambda a: f"CASE WHEN coalesce(CAST(({a[0]}) AS BOOLEAN), FALSE) THEN {a[1]} ELSE {a[2]} END",
    "DATEDIFF": lambda a: f"(({_ms(a[0])} - {_ms(a[1])}) div 86400000)",
    "DATEADD": lambda a: _date_add(a[2], a[1], a[0]),
    "TIMESTAMPADD": lambda a: _date_add(a[2], a[1], a[0]),
    "DATE_ADD": lambda a: _date_add(a[0], a[1], a[2] if len(a) > 2 else "DAY"),
    "DATE_SUB": lambda a: _date_add(a[0], a[1], a[2] if len(a) > 2 else "DAY", "-"),
    "DATEPART": lambda a: _datepart(*a),
    "DATE_FORMAT": lambda a: _date_format(*a),
    "TIME_BUCKET": lambda a: _time_bucket(*a),
    "WEEKDAY": lambda a: f"(dayofweek({a[0]}) - 1)",
    "WEEK": lambda a: _week(a[0]),
    "LAST_DAY": lambda a: f"timestamp_millis({_ms(f'last_day({a[0]})')} + pmod({_ms(a[0])}, 86400000))",
    "TIMESTAMPDIFF": lambda a: _timestampdiff(*a),
    "DATE_TRUNC": lambda a: _trunc(*a),
    "JSON_KEYS": lambda a: f"array_join(sort_array(json_object_keys({a[0]})), ',')",
    "JSON_VALID": lambda a: f"(try_parse_json({a[0]}) IS NOT NULL)",
    "JSON_SET": lambda a: f"json_set_value({a[0]}, {a[1]}, {_as_json(a[2])})",
    "JSON_REMOVE": lambda a: f"json_remove_value({a[0]}, {a[1]})",
    "JSON_TYPE": lambda a: _json_type(a[0]),
    "JSON_OBJECTAGG": lambda a: f"to_json(map_from_entries(array_sort(collect_list(CASE WHEN {a[0]} IS NOT NULL THEN struct(CAST({a[0]} AS STRING) AS k, {a[1]} AS v) END))))",
    "JSON_ARRAY_LENGTH": lambda a: f"json_array_length({a[0]})" if len(a) == 1 else f"json_array_length(get_json_object({a[0]}, {a[1]}))",
    "JSON_CONTAINS": lambda a: f"CASE WHEN ltrim({a[0]}) LIKE '[%' THEN coalesce(array_contains(from_json({a[0]}, 'array<string>'), CAST({a[1]} AS STRING)), FALSE) ELSE coalesce(array_contains(json_object_keys({a[0]}), CAST({a[1]} AS STRING)), FALSE) END",
    "GROUP_CONCAT": lambda a: _listed(*a),
    "STRING_AGG": lambda a: _listed(*a),
    "REPLACE": lambda a: f"CASE WHEN {a[1]} = '' THEN regexp_replace({a[0]}, '', {a[2]}) ELSE replace({a[0]}, {a[1]}, {a[2]}) END",
    "JSON_ARRAYAGG": lambda a: f"to_json(transform(collect_list(struct({a[0]} AS v)), x -> x.v))",
    "ARRAY_AGG": lambda a: f"nullif(to_json(collect_list({a[0]})), '[]')",
    "BOOL_AND": lambda a: f"bool_and(CAST({a[0]} AS BOOLEAN))",
    "BOOL_OR": lambda a: f"bool_or(CAST({a[0]} AS BOOLEAN))",
    "PERCENTILE_CONT": lambda a: f"percentile_cont({a[0]})" if len(a) == 1 else f"percentile_cont({a[0]}) WITHIN GROUP (ORDER BY {a[1]})",
    "PERCENTILE_DISC": lambda a: f"percentile_disc({a[0]})" if len(a) == 1 else f"percentile_disc({a[0]}) WITHIN GROUP (ORDER BY {a[1]})",
    "SHA2": lambda a: f"sha2({a[0]}, 256)" if len(a) == 1 or a[1] in ("0", "256") else "CAST(NULL AS STRING)",
    "VEC_COSINE": lambda a: _distance("cosine", *a),
    "VEC_DISTANCE": lambda a: _distance("cosine", *a),
    "VEC_L2": lambda a: _distance("l2", *a),
    "VEC_DOT": lambda a: _distance("dot", *a),
    "GEOPOINT": lambda a: f"named_struct('lat', CAST({a[0]} AS DOUBLE), 'lng', CAST({a[1]} AS DOUBLE))",
    "ST_DISTANCE": lambda a: _haversine(f"{a[0]}.lat", f"{a[0]}.lng", f"({a[1]}).lat", f"({a[1]}).lng"),
    "ST_WITHIN": lambda a: f"coalesce({_haversine(f'{a[0]}.lat', f'{a[0]}.lng', f'({a[1]})', f'({a[2]})')} <= {a[3]}, FALSE)",
    "CONVERT": lambda a: _cast(a[1], a[0]),
    "ROW_COUNT": lambda a: "0",
    "LAST_INSERT_ID": lambda a: "0",
    "CONNECTION_ID": lambda a: "0",
}

TYPES = {
    "int": "BIGINT", "integer": "BIGINT", "bigint": "BIGINT", "smallint": "BIGINT", "tinyint": "BIGINT", "mediumint": "BIGINT", "serial": "BIGINT", "numeric": "BIGINT",
    "float": "DOUBLE", "double": "DOUBLE", "real": "DOUBLE", "number": "DOUBLE", "decimal": "DOUBLE", "boolean": "BOOLEAN", "bool": "BOOLEAN", "blob": "BINARY", "bytes": "BINARY",
    "bytea": "BINARY", "timestamp": "TIMESTAMP", "datetime": "TIMESTAMP", "timestamptz": "TIMESTAMP", "date": "DATE", "time": "BIGINT", "vector": "ARRAY<FLOAT>",
    "geopoint": "STRUCT<lat: DOUBLE, lng: DOUBLE>", "geo": "STRUCT<lat: DOUBLE, lng: DOUBLE>", "point": "STRUCT<lat: DOUBLE, lng: DOUBLE>", "geometry": "STRUCT<lat: DOUBLE, lng: DOUBLE>",
}


def type_of(name: str, has_arguments: bool = False) -> str:
    """Spark's type for a declared one; NUMERIC with a precision is a double; what is not listed is text."""
    return "DOUBLE" if name == "numeric" and has_arguments else TYPES.get(name.lower(), "STRING")


def _cast(value: str, kind: str) -> str:
    kind = type_of(re.match(r"\w+", kind.strip("'\""))[0], "(" in kind)
    if kind == "BIGINT":
        return f"coalesce(try_cast({value} AS BIGINT), try_cast(try_cast({value} AS DOUBLE) AS BIGINT))"
    if kind == "BOOLEAN":
        return f"CASE WHEN ({value}) IS NOT NULL THEN lower(CAST({value} AS STRING)) IN ('true', '1', 'yes') END"
    return f"CAST({value} AS STRING)" if kind == "STRING" else f"try_cast({value} AS {kind})"


_CLAUSES = ("LIMIT", "OFFSET", "FETCH", "UNION", "INTERSECT", "EXCEPT", "ROWS", "RANGE", "RETURNING")


def _ordering(tokens: list[Token]) -> str:
    """Items of ORDER BY with NULLs last when ascending and first when descending, unless stated."""
    items = []
    for item in split_at(tokens):
        words = [t.word for t in item]
        text = rewrite(item)
        items.append(text if "NULLS" in words else f"{text} NULLS {'FIRST' if 'DESC' in words else 'LAST'}")
    return ", ".join(items)


def _operand(tokens: list[Token], at: int) -> int:
    """Position after an operand: a sign and a literal, a name with dots, or a call."""
    if tokens[at].text == "-":
        at += 1
    at += 1
    while at < len(tokens) and tokens[at].text == "." and at + 1 < len(tokens):
        at += 2
    if at < len(tokens) and tokens[at].text == "(" and tokens[at - 1].is_name:
        at = closing(tokens, at) + 1
    return at


def rewrite(tokens: list[Token]) -> str:
    """Spark SQL for an expression or a query of the dialect."""
    out: list[str] = []
    i = 0
    while i < len(tokens):
        t = tokens[i]
        following = tokens[i + 1] if i + 1 < len(tokens) else Token(" ")
        if t.word == "SELECT":
            text, i = _select(tokens, i)
            out.append(text)
            continue
        if t.word == "ORDER" and following.word == "BY":
            end = find(tokens, *_CLAUSES, start=i + 2)
            end = len(tokens) if end < 0 else end
            out.append("ORDER BY " + _ordering(tokens[i + 2 : end]))
            i = end
            continue
        if t.word == "FETCH" and following.word in ("FIRST", "NEXT"):
            out.append(f"LIMIT {tokens[i + 2].text}")
            i += 5
            continue
        if t.word == "CAST" and following.text == "(":
            end = closing(tokens, i + 1)
            inside = tokens[i + 2 : end]
            at = find(inside, "AS")
            out.append(_cast(rewrite(inside[:at]), " ".join(x.text for x in inside[at + 1 :])))
            i = end + 1
            continue
        if t.is_name and following.text == "(" and (t.word in _CALLS or t.word in _PLAIN or t.word in ("SUM", "NTILE")):
            end = closing(tokens, i + 1)
            inside = tokens[i + 2 : end]
            over = end + 1 < len(tokens) and tokens[end + 1].word == "OVER"
            if t.word == "NTILE":
                stop = closing(tokens, end + 2)
                out.append(_ntile(rewrite(inside), tokens[end + 3 : stop]))
                i = stop + 1
                continue
            if t.word == "SUM":
                # No rows add up to 0.
                out.append(f"sum({rewrite(inside)})" if over else f"coalesce(sum({rewrite(inside)}), 0)")
                i = end + 1
                continue
            arguments = [rewrite(a) for a in split_at(inside)] if inside else []
            out.append(_CALLS[t.word](arguments) if t.word in _CALLS else f"{_PLAIN[t.word]}({', '.join(arguments)})")
            i = end + 1
            continue
        if t.text == "[":
            end = closing(tokens, i)
            out.append("array(" + ", ".join(_vector_item(a) for a in split_at(tokens[i + 1 : end])) + ")")
            i = end + 1
            continue
        if t.is_name and t.word not in ("AND", "OR", "NOT", "WHERE", "HAVING", "ON", "WHEN", "THEN", "ELSE", "BETWEEN", "IN", "IS", "SET", "ROWS", "RANGE", "CASE", "AS", "BY"):
            end = _operand(tokens, i)
            predicate = _predicate(tokens, i, end)
            if predicate:
                out.append(predicate[0])
                i = predicate[1]
                continue
        if t.text == "(":
            end = closing(tokens, i)
            out.append("(" + rewrite(tokens[i + 1 : end]) + ")")
            i = end + 1
            continue
        if t.text.startswith("$") and t.text[1:].isdigit():
            out.append(f":p{t.text[1:]}")
        elif t.text[0] == '"':
            out.append("`" + t.text[1:-1].replace("`", "``") + "`")
        elif t.is_string:
            out.append(quote(text_of(t)))
        elif t.text[0].isdigit() and re.fullmatch(r"\d+\.\d*|\d+(\.\d*)?[eE][+-]?\d+", t.text) or re.fullmatch(r"\.\d+", t.text):
            out.append(t.text + "D")  # a double, as columns of numbers with fractions are
        else:
            out.append(t.text)
        i += 1
    return _joined(out)


def _vector_item(tokens: list[Token]) -> str:
    text = rewrite(tokens)
    return text if len(tokens) > 2 or text.endswith("D") else text + "D"


def _ntile(buckets: str, window: list[Token]) -> str:
    """floor(i * k / n) + 1 for the row at i of n."""
    order = find(window, "ORDER")
    group = rewrite(window[:order] if order >= 0 else window)
    return f"CAST(floor((row_number() OVER ({rewrite(window)}) - 1) * {buckets} / count(1) OVER ({group})) + 1 AS INT)"


def _joined(parts: list[str]) -> str:
    text = ""
    for p in parts:
        text += p if not text or p in (".", ",", ")") or text[-1] in ".(" or (p == "(" and text[-1].isalnum()) else " " + p
    return text


def _predicate(tokens: list[Token], start: int, end: int) -> tuple[str, int] | None:
    """A test whose left side is the operand at start, with the dialect's two values; and the position after it."""
    if end >= len(tokens):
        return None
    operand, value = tokens[start:end], None
    if tokens[end].text == "->>" and end + 1 < len(tokens) and tokens[end + 1].is_string:
        path = f"get_json_object({_plain(operand)}, {quote('$.' + text_of(tokens[end + 1]))})"
        value = f"CASE WHEN NOT ltrim({path}) RLIKE '^[\\\\[{{]' THEN {path} END"
        end += 2
        if end >= len(tokens):
            return value, end
    left = value or _plain(operand)
    negated = tokens[end].word == "NOT"
    at = end + 1 if negated else end
    word = tokens[at].word if at < len(tokens) else ""
    default = "TRUE" if negated else "FALSE"
    no = "NOT " if negated else ""
    if word in ("!=", "<>"):
        after = _operand(tokens, at + 1)
        return f"NOT ({left} <=> {rewrite(tokens[at + 1 : after])})", after
    if word == "=" and at + 1 < len(tokens) and tokens[at + 1].word == "NULL":
        return f"{left} IS NULL", at + 2
    if word == "IN" and at + 1 < len(tokens) and tokens[at + 1].text == "(":
        after = closing(tokens, at + 1)
        inside = tokens[at + 2 : after]
        if inside and inside[0].word in ("SELECT", "WITH"):
            query = rewrite(inside)
            # A NULL in the query would make every NOT IN unknown; a NULL on the left passes it.
            return (f"({left} IS NULL OR NOT EXISTS (SELECT 1 FROM ({query}) AS q(v) WHERE q.v = {left}))" if negated else f"{left} IN ({query})"), after + 1
        return f"coalesce({left} {no}IN ({rewrite(inside)}), {default})", after + 1
    if word == "BETWEEN":
        middle = find(tokens, "AND", start=at + 1)
        after = _operand(tokens, middle + 1)
        return f"coalesce({left} {no}BETWEEN {rewrite(tokens[at + 1 : middle])} AND {rewrite(tokens[middle + 1 : after])}, {default})", after
    if word == "LIKE":
        after = at + 2
        escape = ""
        if after + 1 < len(tokens) and tokens[after].word == "ESCAPE":
            mark = text_of(tokens[after + 1])
            escape = f" ESCAPE {quote(mark)}"
            after += 2
            if tokens[at + 1].is_string:
                # Before a character that stands for itself the mark says nothing, which Spark takes for an error.
                plain = re.sub(f"(?s){re.escape(mark)}(.)", lambda m: m[0] if m[1] in ("%", "_", mark) else m[1], text_of(tokens[at + 1]))
                return f"coalesce({left} {no}ILIKE {quote(plain)}{escape}, {default})", after
        return f"coalesce({left} {no}ILIKE {rewrite([tokens[at + 1]])}{escape}, {default})", after
    if word in ("GLOB", "REGEXP") and at + 1 < len(tokens) and tokens[at + 1].is_string:
        pattern = text_of(tokens[at + 1])
        return f"coalesce({no}{left} RLIKE {quote(glob_to_regex(pattern) if word == 'GLOB' else pattern)}, {default})", at + 2
    return (value, end) if value else None


def _plain(tokens: list[Token]) -> str:
    if len(tokens) > 1 and tokens[-1].text == ")":
        return rewrite(tokens)
    return "".join("`" + t.text[1:-1] + "`" if t.text[0] == '"' else t.text for t in tokens)


def _select(tokens: list[Token], at: int) -> tuple[str, int]:
    """SELECT with the parts that Spark has no word for: DISTINCT ON."""
    if at + 2 < len(tokens) and tokens[at + 1].word == "DISTINCT" and tokens[at + 2].word == "ON":
        close = closing(tokens, at + 3)
        keys = rewrite(tokens[at + 4 : close])
        source = find(tokens, "FROM", start=close + 1)
        order = find(tokens, "ORDER", start=source)
        stop = find(tokens, "LIMIT", "OFFSET", "FETCH", "UNION", "INTERSECT", "EXCEPT", start=source)
        stop = len(tokens) if stop < 0 else stop
        body_end = order if 0 <= order < stop else stop
        ordering = _ordering(tokens[order + 2 : stop]) if 0 <= order < stop else keys
        items, body = rewrite(tokens[close + 1 : source]), rewrite(tokens[source:body_end])
        return f"SELECT {items} FROM (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY {ordering}) AS __first {body}) WHERE __first = 1 ORDER BY {ordering}", stop
    return "SELECT", at + 1


def to_spark(sql: str) -> str:
    """Spark SQL for one query of the dialect."""
    return rewrite(tokenize(sql.strip().rstrip(";")))
