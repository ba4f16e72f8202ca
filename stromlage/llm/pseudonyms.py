"""Format-preserving pseudonyms for personal numbers, dates and mail addresses.

Each value found and validated is replaced by another valid value of the same
format: a Feistel network permutes the values of the format under a key. Equal
values therefore get equal pseudonyms in all documents, whatever separators
they are written with, and different values different ones.

Dates are read with slashes month first, otherwise day first, and in the other
order if only that gives a date. Those with one-digit fields, two-digit years or
the other order are formats of their own: equal days get equal pseudonyms only
within one such format. Version-like numbers that read as a date count as one.

A value is a list of numbers, each below a radix of its own: digits, letters,
octets, or the two digits of a day number. In every round one half of the list
is shifted, number by number and modulo the radices, by a keyed hash (SHA-512)
of the other half.

Built-in SQL functions only. The key becomes part of the query plan; keep plans
and event logs as safe as the key.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 10

#: 1900-01-01 to 2099-12-31 are 73,049 days, that is 17 x 4,297.
FIRST_DAY = "1900-01-01"
DAY_RADICES = (17, 4297)

# Java syntax. Separators are the same within one number.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63})*\.[A-Za-z]{2,24}(?![A-Za-z0-9])",
    "date": r"(?<![0-9./-])(?:[0-9]{4}(?<d>[-/.])[0-9]{1,2}\k<d>[0-9]{1,2}|[0-9]{1,2}(?<e>[-/.])[0-9]{1,2}\k<e>(?:[0-9]{4}|[0-9]{2}))(?![0-9]|[./-][0-9])",
    "ip": r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9]|\.[0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9]|-[0-9])",
    "card": r"(?<![0-9])(?:[0-9]{13,19}|[0-9]{4}(?<f>[ -])[0-9]{4}\k<f>[0-9]{4}\k<f>[0-9]{4}|[0-9]{4}(?<g>[ -])[0-9]{6}\k<g>[0-9]{5})(?![0-9])",
    "phone": r"(?<![0-9])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])",
}
ANY = "|".join(PATTERNS.values())
#: What every match contains; tells most texts apart at once.
HINT = r"[0-9][0-9./-]|[0-9]{3}[) ]|@"


def _sql(text: str) -> str:
    """A raw SQL string literal."""
    return 'r"' + text + '"' if '"' not in text else "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _let(value: str, name: str, body: str) -> str:
    """``body``, with ``name`` for ``value``."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def feistel(values: str, radices: str, tweak: str, key: str) -> str:
    """SQL for the permuted list: both lists are SQL for array<int>, of 1 to 64 numbers."""
    half = "(size(v) div 2)"
    other = f"if(r % 2 = 0, slice(v, {half} + 1, size(v) - {half}), slice(v, 1, {half}))"
    stream = f"sha2(concat_ws('|', {_sql(key)}, '{tweak}', r, array_join(transform({other}, o -> string(o)), ',')), 512)"
    wide = "if(size(v) <= 36, 7, 4)"
    at = f"if(i < {half}, i, i - {half})"
    shifted = (
        f"transform(v, (x, i) -> if((r % 2 = 0) = (i < {half}), "
        f"int((x + bigint(conv(substr(st, int({at} * {wide} + 1), {wide}), 16, 10))) % element_at(p.q, int(i + 1))), x))"
    )
    return _let(
        f"struct({values} AS a, {radices} AS q)", "p",
        f"aggregate(sequence(0, {ROUNDS - 1}), p.a, (v, r) -> {_let(stream, 'st', shifted)})",
    )


def _with_digits(text: str, digits: str) -> str:
    """``text`` with its digits replaced, one after the other, by ``digits`` (SQL for array<int>)."""
    return _let(
        f"struct({text} AS t, {digits} AS g)", "w",
        "aggregate(split(w.t, ''), struct('' AS s, 0 AS k), (z, c) -> if(c RLIKE '^[0-9]$', "
        "struct(concat(z.s, element_at(w.g, z.k + 1)) AS s, z.k + 1 AS k), struct(concat(z.s, c) AS s, z.k AS k)), z -> z.s)",
    )


def _digits(text: str) -> str:
    return f"transform(split(regexp_replace({text}, '[^0-9]', ''), ''), c -> int(c))"


def _luhn(digits: str) -> str:
    """Sum of the check rule over ``digits``, the check digit among them."""
    return (
        f"aggregate(transform(reverse({digits}), (x, i) -> if(i % 2 = 0, x, if(x > 4, 2 * x - 9, 2 * x))), 0, (y, x) -> y + x)"
    )


def _tens(n: str) -> str:
    return f"array_repeat(10, {n})"


def _card(m: str, key: str) -> str:
    body = "slice(d.a, 1, size(d.a) - 1)"
    moved = feistel(body, _tens("size(d.a) - 1"), "card", key)
    check = f"(10 - {_luhn('concat(b, array(0))')} % 10) % 10"
    renewed = _let(moved, "b", f"concat(b, array({check}))")
    return _let(
        f"struct({m} AS t, {_digits(m)} AS a)", "d",
        f"if({_luhn('d.a')} % 10 = 0, {_with_digits('d.t', renewed)}, d.t)",
    )


def _phone(m: str, key: str) -> str:
    """Area and exchange codes start with 2 to 9; the numbers may be written with a country code before."""
    lifted = lambda a, by: f"transform({a}, (x, i) -> if(i = 0 OR i = 3, x {by} 2, x))"
    moved = feistel(lifted("d.a", "-"), "array(8, 10, 10, 8, 10, 10, 10, 10, 10, 10)", "phone", key)
    return _let(
        f"struct({m} AS t, {_digits(m)} AS a)", "d",
        f"if(d.a[0] >= 2 AND d.a[3] >= 2, {_with_digits('d.t', lifted(moved, '+'))}, d.t)",
    )


def _ssn(m: str, key: str) -> str:
    """Areas 001 to 899 without 666, groups and serials without the one of zeros only."""
    numbers = f"transform(split({m}, '-'), c -> int(c))"
    index = "array(d.a[0] - if(d.a[0] > 666, 2, 1), d.a[1] - 1, d.a[2] - 1)"
    moved = feistel(index, "array(898, 99, 9999)", "ssn", key)
    shown = _let(
        moved, "b",
        "concat_ws('-', lpad(string(b[0] + if(b[0] >= 665, 2, 1)), 3, '0'), lpad(string(b[1] + 1), 2, '0'), lpad(string(b[2] + 1), 4, '0'))",
    )
    valid = "d.a[0] BETWEEN 1 AND 899 AND d.a[0] <> 666 AND d.a[1] > 0 AND d.a[2] > 0"
    return _let(f"struct({m} AS t, {numbers} AS a)", "d", f"if({valid}, {shown}, d.t)")


def _ip(m: str, key: str) -> str:
    moved = feistel("d.a", "array(256, 256, 256, 256)", "ip", key)
    return _let(
        f"struct({m} AS t, transform(split({m}, '[.]'), c -> int(c)) AS a)", "d",
        f"if(array_max(d.a) < 256, array_join(transform({moved}, x -> string(x)), '.'), d.t)",
    )


def _is_date(year: str, month: str, day: str) -> str:
    return f"try_to_timestamp(concat_ws('-', {year}, lpad({month}, 2, '0'), lpad({day}, 2, '0')), 'yyyy-MM-dd') IS NOT NULL"


def _whole_date(m: str, key: str) -> str:
    """Two-digit days and months, years of four digits, in the usual order: all days of 1900 to 2099 are one format."""
    first = "substr(d.t, 5, 1) RLIKE '[-/.]'"
    sep = f"if({first}, substr(d.t, 5, 1), substr(d.t, 3, 1))"
    form = f"if({first}, concat('yyyy', {sep}, 'MM', {sep}, 'dd'), if({sep} = '/', 'MM/dd/yyyy', concat('dd', {sep}, 'MM', {sep}, 'yyyy')))"
    a, b = DAY_RADICES
    moved = feistel(f"array(int(g.n div {b}), int(g.n % {b}))", f"array({a}, {b})", "date", key)
    shown = _let(moved, "b", f"date_format(date_add(DATE'{FIRST_DAY}', b[0] * {b} + b[1]), g.f)")
    days = f"datediff(date(try_to_timestamp(d.t, {form})), DATE'{FIRST_DAY}')"
    return _let(
        f"struct({m} AS t)", "d",
        _let(f"struct({form} AS f, {days} AS n)", "g", f"if(g.n IS NOT NULL AND g.n >= 0 AND g.n < {a * b}, {shown}, d.t)"),
    )


def _other_date(t: str, key: str) -> str:
    """Dates with one-digit fields, two-digit years (of 2000 to 2099) or the less usual order of day and month.

    The numbers of year, month and day move among those of months equally long.
    Widths stay; a day that settled the order stays above 12, so the pseudonym is read the same way.
    """
    # k: the three fields; y: year; u, w: month and day in the usual order.
    usual = "(length(k.k[0]) = 4 OR instr(k.t, '/') > 0)"
    a, b = "if(length(k.k[0]) = 4, k.k[1], k.k[0])", "if(length(k.k[0]) = 4, k.k[2], k.k[1])"
    year = "if(length(k.k[0]) = 4, k.k[0], if(length(k.k[2]) = 2, concat('20', k.k[2]), k.k[2]))"
    read = f"struct(k.t AS t, k.k AS k, {year} AS y, {usual} AS mf, {a} AS a, {b} AS b)"
    ordered = (
        f"struct(e.t AS t, e.k AS k, e.y AS y, if(e.mf, {_is_date('e.y', 'e.a', 'e.b')}, {_is_date('e.y', 'e.b', 'e.a')}) AS same, e.mf AS mf, e.a AS a, e.b AS b)"
    )
    # mf: whether the month stands before the day.
    settled = "struct(h.t AS t, h.k AS k, h.y AS y, h.same AS same, (h.mf = h.same) AS mf, if(h.mf = h.same, h.a, h.b) AS mo, if(h.mf = h.same, h.b, h.a) AS da)"
    leap = "(x % 4 = 0 AND (x % 100 <> 0 OR x % 400 = 0))"
    leap_now = leap.replace("x", "int(z.y)")
    length = "CASE WHEN x = 2 THEN 28 WHEN x IN (4, 6, 9, 11) THEN 30 ELSE 31 END"
    now = length.replace("x", "int(z.mo)")
    span = "if(length(z.k[0]) = 4 OR length(z.k[2]) = 4, sequence(1900, 2099), sequence(2000, 2099))"
    years = f"filter({span}, x -> int(z.mo) <> 2 OR {leap} = {leap_now})"
    months = f"filter(sequence(1, if(length(z.mo) = 1, 9, 12)), x -> {length} = {now})"
    last = f"if(length(z.da) = 1, 9, {now} + if(int(z.mo) = 2 AND {leap_now}, 1, 0))"
    days = f"sequence(if(z.same, 1, 13), {last})"
    lists = f"struct({years} AS ys, {months} AS ms, {days} AS ds)"
    places = "array(int(array_position(l.ys, int(z.y))) - 1, int(array_position(l.ms, int(z.mo))) - 1, int(array_position(l.ds, int(z.da))) - 1)"
    moved = feistel(places, "array(size(l.ys), size(l.ms), size(l.ds))", "date fields", key)
    sep = "substr(z.t, length(z.k[0]) + 1, 1)"
    month, day = "lpad(string(l.ms[n[1]]), length(z.mo), '0')", "lpad(string(l.ds[n[2]]), length(z.da), '0')"
    pair = f"if(z.mf, concat({month}, {sep}, {day}), concat({day}, {sep}, {month}))"
    whole = f"if(length(z.k[0]) = 4, concat(string(l.ys[n[0]]), {sep}, {pair}), concat({pair}, {sep}, substr(string(l.ys[n[0]]), 5 - length(z.k[2]))))"
    shown = _let(lists, "l", _let(moved, "n", whole))
    valid = f"int(z.y) BETWEEN 1900 AND 2099 AND {_is_date('z.y', 'z.mo', 'z.da')}"
    return _let(
        f"struct({t} AS t, split({t}, '[-/.]') AS k)", "k",
        _let(read, "e", _let(ordered, "h", _let(settled, "z", f"if({valid}, {shown}, z.t)"))),
    )


def _date(m: str, key: str) -> str:
    """Year first, or else day first; with slashes month first; the other order if only that is a date. Years 1900 to 2099."""
    of = lambda y, mo, da: _is_date(*(f"substr({m}, {at}, {n})" for at, n in ((y, 4), (mo, 2), (da, 2))))
    usual = (
        f"length({m}) = 10 AND CASE WHEN {m} RLIKE '^[0-9]{{4}}' THEN {of(1, 6, 9)} "
        f"WHEN instr({m}, '/') > 0 THEN {of(7, 1, 4)} ELSE {of(7, 4, 1)} END"
    )
    return f"CASE WHEN {usual} THEN {_whole_date(m, key)} ELSE {_other_date(m, key)} END"


def _email(m: str, key: str) -> str:
    """Letters and digits before the @, each within its kind."""
    kind = "CASE WHEN c RLIKE '^[0-9]$' THEN 48 WHEN c RLIKE '^[a-z]$' THEN 97 WHEN c RLIKE '^[A-Z]$' THEN 65 ELSE 0 END"
    radix = "CASE k WHEN 0 THEN 1 WHEN 48 THEN 10 ELSE 26 END"
    moved = feistel(
        "zip_with(d.c, d.k, (c, k) -> if(k = 0, 0, ascii(c) - k))", f"transform(d.k, k -> {radix})", "email", key
    )
    shown = f"zip_with(d.c, zip_with(d.k, {moved}, (k, x) -> struct(k AS k, x AS x)), (c, y) -> if(y.k = 0, c, chr(y.k + y.x)))"
    local = f"split(split_part({m}, '@', 1), '')"
    return _let(
        f"struct({m} AS t, {local} AS c, transform({local}, c -> {kind}) AS k)", "d",
        f"concat(array_join({shown}, ''), substr(d.t, instr(d.t, '@')))",
    )


def _pseudonym(m: str, key: str) -> str:
    """SQL for what replaces the match ``m``; kinds are told apart by their form."""
    digits = f"length(regexp_replace({m}, '[^0-9]', ''))"
    return (
        f"CASE WHEN instr({m}, '@') > 0 THEN {_email(m, key)} "
        f"WHEN {m} RLIKE '^[0-9]{{1,3}}([.][0-9]{{1,3}}){{3}}$' THEN {_ip(m, key)} "
        f"WHEN {m} RLIKE '^[0-9]{{3}}-[0-9]{{2}}-[0-9]{{4}}$' THEN {_ssn(m, key)} "
        f"WHEN {digits} < 9 THEN {_date(m, key)} "
        f"WHEN {digits} = 10 THEN {_phone(m, key)} "
        f"ELSE {_card(m, key)} END"
    )


def pseudonymised(text: str, key: str) -> Column:
    """The text column with every value replaced; null stays null."""
    found, between = f"regexp_extract_all(`{text}`, {_sql(ANY)}, 0)", f"split(`{text}`, {_sql(ANY)}, -1)"
    rebuilt = (
        f"array_join(zip_with({between}, transform({found}, m -> {_pseudonym('m', key)}), (s, y) -> concat(s, coalesce(y, ''))), '')"
    )
    return F.expr(f"CASE WHEN `{text}` RLIKE {_sql(HINT)} AND `{text}` RLIKE {_sql(ANY)} THEN {rebuilt} ELSE `{text}` END")


def pseudonymise(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """``docs`` with the personal values in ``text`` replaced; all other columns as they are.

    Row by row, without a shuffle: null and empty texts stay, repeated rows
    stay equal, an empty table stays empty. What fails its check (card check
    digit, calendar, number plans, octets) is left alone.
    """
    return docs.withColumn(text, pseudonymised(text, key))
