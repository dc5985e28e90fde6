"""PII: format-preserving Feistel pseudonyms, by DataFrame functions only.

Card numbers (Luhn), social security numbers, IPv4 addresses, phone numbers, dates and e-mail addresses are found by
pattern, validated, turned into whole numbers of their own domain, permuted there by a keyed Feistel network of two
unequal halves (each round adds a keyed hash of one half to the other, modulo that half's size), and written back in the
same layout. The permutation is a bijection of valid values onto valid values, so equal values stay equal across
documents and different ones stay different, and every replacement passes the same validation. What fails validation is
left as it is.

Domains: cards keep their length and first digit, and get the check digit that fits; social security numbers stay in
the assigned ranges; IPv4 addresses range over all addresses; North American numbers keep assignable area and exchange codes
(from 200) assignable, other international numbers keep the country code; dates stay in their century and stay valid, and
stay readable in both orders if they were; the letters and digits of an address's local part are permuted chunk by chunk
in base 36, its domain stays.

Defined results: null text stays null with counts 0; empty texts stay; control characters used as marks inside are
escaped first, so any text is safe; texts of any length are read whole; repeated rows get equal results; one date in two
layouts counts as two values; an empty table gives an empty result; other columns are kept, and a clash of names with the
new ones is avoided by leading underscores.
"""

from __future__ import annotations

import secrets

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .util import column_name

# The patterns.
# a host up to its last dot before two letters; possessive loops of groups, as Java's others go a call deeper with each label
EMAIL = r"[A-Za-z0-9][A-Za-z0-9._%+\-]*+@(?:[A-Za-z0-9\-]++(?:\.(?![A-Za-z]{2})[A-Za-z0-9\-]++)*+\.(?=[A-Za-z]{2}))++[A-Za-z]{2,}"
IPV4 = r"(?<![0-9]\.)(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?!\.?[0-9])"
ISO_DATE = r"[0-9]{4}-[0-9]{2}-[0-9]{2}(?![0-9\-])"
DATE = r"(?:[0-9]{1,2}\.[0-9]{1,2}\.|[0-9]{1,2}/[0-9]{1,2}/)[0-9]{4}(?![0-9])"
SSN = r"[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9\-])"
NANP = r"(?:\+?1[ .\-]?)?\(?[0-9]{3}\)?[ .\-][0-9]{3}[ .\-][0-9]{4}(?![0-9])"
# digits one by one, 15 at most with the country code and the part in brackets, so that no later number is drawn in
ABROAD = r"\+(?:[0-9](?:[ .\-]?[0-9]){6,14}|" + "|".join(rf"[0-9]{{{c}}}[ .\-]?\([0-9]{{{p}}}\)(?:[ .\-]?[0-9]){{2,{15 - c - p}}}" for c in (1, 2, 3) for p in (1, 2, 3, 4)) + ")(?![0-9])"
CARD = r"(?:[0-9]{13,19}|[0-9]{4}(?:[ \-][0-9]{4}){3}|3[47][0-9]{2}[ \-][0-9]{6}[ \-][0-9]{5})(?![0-9A-Za-z])"
ALL = r"(?<![A-Za-z0-9])(?:" + "|".join([EMAIL, IPV4, ISO_DATE, DATE, SSN, NANP, ABROAD, CARD]) + ")"
KINDS = ("card", "ssn", "ipv4", "phone", "date", "email")
ROUNDS = 10
MARK, ESCAPE = "\u0001\u0003", "\u0001\u0002"


def _num(text: Column) -> Column:
    return text.cast("bigint")


def feistel(left: Column, right: Column, a: Column | int, b: Column | int, domain: Column | str, key: str) -> Column:
    """A struct (l, r): the keyed permutation of pairs below (a, b); domain separates the permutations of one key."""
    a, b = (x if isinstance(x, Column) else F.lit(x).cast("bigint") for x in (a, b))
    domain = domain if isinstance(domain, Column) else F.lit(domain)

    def mix(k, half):
        digest = F.sha2(F.concat_ws("|", F.lit(key), domain, k.cast("string"), half.cast("string")), 256)
        return F.conv(F.substring(digest, 1, 14), 16, 10).cast("bigint")

    def step(state, k):
        even = k % 2 == 0
        return F.struct(
            F.when(even, F.pmod(state["l"] + F.pmod(mix(k, state["r"]), a), a)).otherwise(state["l"]).alias("l"),
            F.when(even, state["r"]).otherwise(F.pmod(state["r"] + F.pmod(mix(k, state["l"]), b), b)).alias("r"),
        )

    start = F.struct(left.cast("bigint").alias("l"), right.cast("bigint").alias("r"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step)


def _with(value: Column, use) -> Column:
    """use(value), with value worked out once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _permuted(index: Column, a: int, b: int, domain: Column | str, key: str) -> Column:
    """A number below a * b, permuted."""
    return _with(feistel(F.expr("null") if index is None else F.floor(index / b).cast("bigint"), F.pmod(index, F.lit(b)), a, b, domain, key), lambda s: s["l"] * b + s["r"])


def _padded(n: Column, width: Column | int) -> Column:
    return F.lpad(n.cast("string"), width, "0")


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _refilled(layout: Column, digits: Column) -> Column:
    """layout with its digits replaced, in order."""
    start = F.struct(F.lit(1).alias("at"), F.lit("").alias("out"))

    def step(s, c):
        own = c.rlike("[0-9]")
        return F.struct((s["at"] + own.cast("int")).alias("at"), F.concat(s["out"], F.when(own, F.substr(digits, s["at"], F.lit(1))).otherwise(c)).alias("out"))

    return F.aggregate(F.split(layout, ""), start, step)["out"]


def luhn(digits: Column) -> Column:
    """The Luhn sum of a string of digits, whose last one counts once."""
    each = F.split(F.reverse(digits), "")
    values = F.transform(F.filter(each, lambda c: c != ""), lambda c, k: F.when(k % 2 == 0, c.cast("int")).otherwise(c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(values, F.lit(0), lambda s, v: s + v)


def _halves(body: Column, base: int, domain: Column, key: str) -> Column:
    """A string of digits of the given base (lower case), permuted among those of its length (at most 18, or 12 of base 36)."""
    n = F.length(body)
    a = F.floor(n / 2).cast("int")
    size = lambda k: F.round(F.pow(F.lit(float(base)), k)).cast("bigint")
    part = lambda text: F.coalesce(F.conv(F.when(text != "", text), base, 10).cast("bigint"), F.lit(0))
    done = feistel(part(F.substr(body, F.lit(1), a)), part(F.substr(body, a + 1)), size(a), size(n - a), F.concat_ws(":", domain, n.cast("string")), key)
    write = lambda half, k: F.when(k > 0, F.lpad(F.lower(F.conv(half.cast("string"), 10, base)), k, "0")).otherwise("")
    return _with(done, lambda s: F.concat(write(s["l"], a), write(s["r"], n - a)))


def _card(text: Column, key: str) -> Column:
    digits = _digits(text)

    def write(d):
        body = F.concat(F.substr(d, F.lit(1), F.lit(1)), _halves(F.substr(d, F.lit(2), F.length(d) - 2), 10, F.concat(F.lit("card"), F.substr(d, F.lit(1), F.lit(1))), key))
        return _with(body, lambda x: F.concat(x, F.pmod(10 - luhn(F.concat(x, F.lit("0"))) % 10, F.lit(10)).cast("string")))

    return F.when(luhn(digits) % 10 == 0, _refilled(text, _with(digits, write)))


def _ssn(text: Column, key: str) -> Column:
    area, group, serial = (_num(F.substr(text, F.lit(k), F.lit(n))) for k, n in ((1, 3), (5, 2), (8, 4)))
    valid = (area > 0) & (area < 900) & (area != 666) & (group > 0) & (serial > 0)
    done = feistel(area - 1 - (area > 666).cast("int"), (group - 1) * 9999 + serial - 1, 898, 99 * 9999, "ssn", key)

    def write(s):
        new = s["l"] + 1 + (s["l"] >= 665).cast("int")
        return F.concat_ws("-", _padded(new, 3), _padded(F.floor(s["r"] / 9999) + 1, 2), _padded(s["r"] % 9999 + 1, 4))

    return F.when(valid, _with(done, write))


def _ipv4(text: Column, key: str) -> Column:
    parts = F.transform(F.split(text, r"\."), _num)
    done = feistel(parts[0] * 256 + parts[1], parts[2] * 256 + parts[3], 65536, 65536, "ipv4", key)
    shown = lambda s: F.concat_ws(".", *[x.cast("string") for h in ("l", "r") for x in (F.floor(s[h] / 256), s[h] % 256)])
    return F.when(F.forall(parts, lambda p: p < 256), _with(done, shown))


def _phone(text: Column, key: str) -> Column:
    digits = _digits(text)
    ten = F.substr(digits, F.greatest(F.length(digits) - 9, F.lit(1)))
    area, exchange, line = (_num(F.substr(ten, F.lit(k), F.lit(n))) for k, n in ((1, 3), (4, 3), (7, 4)))
    american = text.rlike("^" + NANP + "$")
    # each of area and exchange stays below 200 or from 200 on (only the latter are assigned)
    low, small = (F.when(x < 200, 0).otherwise(200).cast("bigint") for x in (area, exchange))
    count = lambda least: F.when(least == 0, 200).otherwise(800).cast("bigint")
    done = feistel(area - low, (exchange - small) * 10000 + line, count(low), count(small) * 10000, F.concat_ws(":", F.lit("nanp"), low, small), key)
    shown = lambda s: F.concat(F.substr(digits, F.lit(1), F.length(digits) - 10), _padded(s["l"] + low, 3), _padded(s["r"] + small * 10000, 7))
    code = F.length(F.regexp_extract(text, r"^\+([0-9]{1,3})", 1))
    rest = F.substr(digits, code + 1)
    abroad = F.concat(F.substr(digits, F.lit(1), code), _halves(rest, 10, F.concat(F.lit("phone"), F.substr(digits, F.lit(1), code)), key))
    return F.when(american, _refilled(text, _with(done, shown))).when((F.length(digits) >= 7) & (F.length(digits) <= 15) & (F.length(rest) >= 4), _refilled(text, abroad))


def _leap(year: Column) -> Column:
    return ((year % 4 == 0) & (year % 100 != 0)) | (year % 400 == 0)


def _days(year: Column, month: Column) -> Column:
    return F.when(month == 2, 28 + _leap(year).cast("int")).when(month.isin(4, 6, 9, 11), 30).otherwise(31)


def _iso_date(text: Column, key: str) -> Column:
    year, month, day = (_num(F.substr(text, F.lit(k), F.lit(n))) for k, n in ((1, 4), (6, 2), (9, 2)))
    valid = (year >= 1900) & (year < 2100) & (month >= 1) & (month <= 12) & (day >= 1) & (day <= _days(year, month))

    def within(first: str, a: int, b: int) -> Column:  # a * b is the number of days of the century
        index = F.date_diff(F.try_to_date(text, "yyyy-MM-dd"), F.lit(first).cast("date"))
        return F.date_format(F.date_add(F.lit(first).cast("date"), _permuted(index, a, b, "date" + first, key).cast("int")), "yyyy-MM-dd")

    return F.when(valid, F.when(year < 2000, within("1900-01-01", 92, 397)).otherwise(within("2000-01-01", 75, 487)))


def _other_date(text: Column, key: str) -> Column:
    """Day and month in either order before the year. Dates readable in both orders, and days 13 to 28, are permuted as
    a whole; of later days the year is."""
    parts = F.split(text, "[./]")
    x, y, year = (_num(parts[k]) for k in range(3))
    turned = (y > 12) & (x <= 12)
    day, month = F.when(turned, y).otherwise(x), F.when(turned, x).otherwise(y)
    valid = (year >= 1900) & (year < 2100) & (month >= 1) & (month <= 12) & (day >= 1) & (day <= _days(year, month))
    first = F.when(year < 2000, 1900).otherwise(2000)
    century = first.cast("string")
    index = (day - F.when(day <= 12, 1).otherwise(13)) * 1200 + (month - 1) * 100 + year - first
    soon = _permuted(index, 144, 100, F.concat(F.lit("both"), century), key)
    late = _permuted(index, 160, 120, F.concat(F.lit("late"), century, turned.cast("string")), key)
    rest = _permuted(year - first, 10, 10, F.concat_ws("-", F.lit("year"), century, day.cast("string"), month.cast("string")), key)
    leap = F.when(year < 2000, 4 + 4 * _permuted(F.floor((year - 1904) / 4), 6, 4, "leap1900", key)).otherwise(4 * _permuted(F.floor((year - 2000) / 4), 5, 5, "leap2000", key))
    by_index = lambda n, least: F.struct((F.floor(n / 1200) + least).alias("d"), (F.floor(n / 100) % 12 + 1).alias("m"), (n % 100 + first).alias("y"))
    new = (
        F.when(day <= 12, _with(soon, lambda n: by_index(n, 1)))
        .when(day <= 28, _with(late, lambda n: by_index(n, 13)))
        .when((day == 29) & (month == 2), F.struct(day.alias("d"), month.alias("m"), (first + leap).alias("y")))
        .otherwise(F.struct(day.alias("d"), month.alias("m"), (first + rest).alias("y")))
    )
    sign = F.when(text.contains("/"), "/").otherwise(".")
    # one digit stays one digit only where the new number has one
    width = lambda n, old: F.lpad(n.cast("string"), F.greatest(F.length(old), F.length(n.cast("string"))), "0")
    shown = lambda s: F.concat(width(F.when(turned, s["m"]).otherwise(s["d"]), parts[0]), sign, width(F.when(turned, s["d"]).otherwise(s["m"]), parts[1]), sign, s["y"].cast("string"))
    return F.when(valid, _with(new, shown))


def _email(text: Column, key: str) -> Column:
    local, host = F.substring_index(text, "@", 1), F.substring_index(text, "@", -1)
    chunks = F.regexp_extract_all(F.lower(local), F.lit("[a-z0-9]{1,12}|[^a-z0-9]+"), F.lit(0))
    new = F.transform(chunks, lambda c: F.when(c.rlike("^[a-z0-9]"), _halves(c, 36, F.lit("email"), key)).otherwise(c))
    return F.concat(F.array_join(new, ""), F.lit("@"), host)


def pseudonym(piece: Column, key: str) -> Column:
    """A struct (kind, value) of a found piece; kind null where it fails validation."""
    ways = [
        ("email", "@", _email), ("ipv4", "^" + IPV4 + "$", _ipv4), ("date", "^" + ISO_DATE + "$", _iso_date), ("date", "^" + DATE + "$", _other_date),
        ("ssn", "^" + SSN + "$", _ssn), ("phone", r"^\+|^" + NANP + "$", _phone), ("card", "", _card),
    ]
    kind, value = F.lit(None).cast("string"), F.lit(None).cast("string")
    for name, pattern, way in reversed(ways):
        kind, value = F.when(piece.rlike(pattern), name).otherwise(kind), F.when(piece.rlike(pattern), way(piece, key)).otherwise(value)
    return _with(value, lambda v: F.struct(F.when(v.isNotNull(), kind).alias("kind"), F.coalesce(v, piece).alias("value")))


def pseudonymise(docs: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """docs with its text replaced, and n_<kind> of each kind behind the other columns."""
    names = [column_name(docs, f"n_{k}") for k in KINDS]
    found, text = column_name(docs, "_pieces"), F.col(f"`{text_col}`").cast("string")
    marked = F.regexp_replace(F.replace(text, F.lit("\u0001"), F.lit(ESCAPE)), ALL, MARK + "$0" + MARK)
    pieces = F.transform(F.split(marked, MARK), lambda p, k: F.when(k % 2 == 1, pseudonym(p, key)).otherwise(F.struct(F.lit(None).cast("string").alias("kind"), p.alias("value"))))
    rows = docs.withColumn(found, F.when(text.rlike("[0-9@]"), pieces))
    joined = F.replace(F.array_join(F.transform(F.col(found), lambda p: p["value"]), ""), F.lit(ESCAPE), F.lit("\u0001"))
    of_kind = lambda k: F.size(F.filter(F.col(found), lambda p: p["kind"] == k))
    counts = [F.when(F.col(found).isNull(), 0).otherwise(of_kind(k)).cast("long").alias(n) for k, n in zip(KINDS, names)]
    kept = [F.when(F.col(found).isNull(), text).otherwise(joined).alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns]
    return rows.select(*kept, *counts)


#: Where the query's key comes from. Only in local mode, as in tests, the key below, which is no secret, stands in for it.
KEY_SETTING = "spark.farside.pii.key"
TEST_KEY = "farside-demonstration-key"
_drawn: dict[str, str] = {}


def query_key(spark) -> str:
    """The session's KEY_SETTING. Where it is missing outside of local mode, a secret key is drawn once for an application
    and stored nowhere: pseudonyms are then linked within the application's results and not with those of others."""
    key = spark.conf.get(KEY_SETTING, None)
    if key is not None:
        return key
    context = spark.sparkContext
    return TEST_KEY if context.master.startswith("local") else _drawn.setdefault(context.applicationId, secrets.token_hex(32))


def op5_pii(spark, sf_dir: str) -> DataFrame:
    """Every document's text with pseudonyms, and how many of each kind, under query_key()."""
    return pseudonymise(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), query_key(spark))
