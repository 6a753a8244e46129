"""Format-preserving pseudonyms for personal data (operator 10).

Candidates are found by one expression, checked (Luhn sums, octets, calendar
days, reserved number ranges), and replaced: a number or date becomes another of
the same format by a keyed Feistel permutation of its domain, so equal values
have equal pseudonyms in all documents and different values never share one.
Cards keep a right check digit, phone numbers their country code and
punctuation, dates stay within 1900 to 2099, addresses stay dotted octets. Mail
addresses aren't numbers; both of their halves become keyed tokens.

Only DataFrame functions are used, and a text is rewritten where it is read: no
shuffle, and no state beyond one row.

A domain of ``size_a * size_b`` values is walked as pairs (a, b): each round adds a
keyed hash of one half to the other, modulo its size, which is a bijection for
any sizes.

Cases: null stays null and has no finds; texts without a digit or ``@`` are passed
by; candidates that fail their check stay as they are; repeated rows and values
get the same result; long texts are whole, and each pattern is bounded, so runs of
digits or letters cost linear time. Columns beside the text are passed through,
and result columns of the same name are replaced. An empty table gives no rows.
Ten digits without any mark between them, and bank account numbers, are left alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillbit.session import load

ROUNDS = 10
KEY = "quillbit demonstration key"
KINDS = ("email", "date", "ip", "ssn", "phone", "card")

_EMAIL = r"(?<![A-Za-z0-9._+-])[A-Za-z0-9._+-]{1,64}@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}(?![A-Za-z0-9-])"
_YMD = r"(?<![0-9A-Za-z./-])[0-9]{4}([/-])[0-9]{2}\1[0-9]{2}(?![0-9A-Za-z/-])"
_DMY = r"(?<![0-9A-Za-z./-])[0-9]{2}([./-])[0-9]{2}\2[0-9]{4}(?![0-9A-Za-z/-]|\.[0-9])"
_IP = r"(?<![0-9A-Za-z.])[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}(?![0-9A-Za-z]|\.[0-9])"
_SSN = r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])"
_PAIRS = "|".join(rf"0[1-9](?:{s}[0-9]{{2}}){{4}}" for s in (" ", r"\.", "-"))
_AREA = r"0[1-9][0-9]{1,3}[ /-][0-9]{5,8}"
_PHONE = "|".join(
    (
        rf"(?<![0-9A-Za-z.+-])(?:{_PAIRS}|{_AREA})(?![0-9A-Za-z-]|\.[0-9]|[ /][0-9])",
        r"(?<![0-9A-Za-z])(?:\+?[0-9]{1,3}[ .-]?)?\([0-9]{3}\)[ .-]?[0-9]{3}[ .-][0-9]{4}(?![0-9A-Za-z])",
        r"(?<![0-9A-Za-z])\+[0-9]{1,3}[ .-]?[0-9]{2,4}[ .-]?[0-9]{3,4}[ .-]?[0-9]{3,4}(?![0-9A-Za-z])",
        r"(?<![0-9A-Za-z.-])[0-9]{3}[.-][0-9]{3}[.-][0-9]{4}(?![0-9A-Za-z-]|\.[0-9])",
    )
)
_CARD = r"(?<![0-9A-Za-z-])(?:[0-9]{13,19}|[0-9]{4}([ -])[0-9]{4}\3[0-9]{4}\3[0-9]{4}|[0-9]{4}([ -])[0-9]{6}\4[0-9]{5})(?![0-9A-Za-z-])"
_ANY = "|".join((_EMAIL, _YMD, _DMY, _IP, _SSN, _PHONE, _CARD))

#: Days from 1900-01-01 to 2099-12-31 are 17 * 4297.
FIRST_YEAR, LAST_YEAR, DAYS = 1900, 2099, (17, 4297)
#: A date with slashes is read month first. If the first number is above 12 it is a day;
#: such dates are permuted among themselves, so that a pseudonym is read as its date was:
#: 221 days from the 13th on in each of 200 years, and the 49 leap days. LATER[m] are
#: those days before the month m + 1.
LATE_DAYS, LEAP_DAYS, FIRST_LEAP = (200, 221), (7, 7), 1904
LATER = (0, 19, 35, 54, 72, 91, 109, 128, 147, 165, 184, 202)


def _secret(key: str, *parts: Column) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(key), *parts), 256)


def feistel(value: Column, size_a: Column, size_b: Column, tweak: Column, key: str, rounds: int = ROUNDS) -> Column:
    """A keyed permutation of 0 .. size_a * size_b - 1."""

    def step(state: Column, i: Column) -> Column:
        a, b = state["a"], state["b"]
        odd = i % 2 == 1
        mix = F.conv(F.substring(_secret(key, tweak, i.cast("string"), F.when(odd, b).otherwise(a).cast("string")), 1, 15), 16, 10).cast("bigint")
        return F.struct(F.when(odd, (a + mix % size_a) % size_a).otherwise(a).alias("a"), F.when(odd, b).otherwise((b + mix % size_b) % size_b).alias("b"))

    # Exact quotient: bigint division by way of double would round above 2^53.
    start = F.struct(((value - value % size_b).cast("decimal(20,0)") / size_b.cast("decimal(20,0)")).cast("bigint").alias("a"), (value % size_b).cast("bigint").alias("b"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, step, lambda s: s["a"] * size_b + s["b"])


def _luhn(digits: Column) -> Column:
    return F.call_function("luhn_check", digits)


def _kind(m: Column) -> Column:
    full = lambda p: m.rlike(f"^(?:{p})$")
    return (
        F.when(F.contains(m, F.lit("@")), "email")
        .when(full(r"[0-9]{4}[/-][0-9]{2}[/-][0-9]{2}"), "ymd")
        .when(full(r"29/02/[0-9]{4}"), "leap")
        .when(full(r"(?:1[3-9]|[2-9][0-9])/[0-9]{2}/[0-9]{4}"), "late")
        .when(full(r"[0-9]{2}[./-][0-9]{2}[./-][0-9]{4}"), "dmy")
        .when(full(r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}"), "ip")
        .when(full(r"[0-9]{3}-[0-9]{2}-[0-9]{4}"), "ssn")
        .when(full(r"[0-9]{13,19}|[0-9]{4}[ -][0-9]{4}[ -][0-9]{4}[ -][0-9]{4}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5}"), "card")
        .otherwise("phone")
    )


def _part(text: Column, start: int, length: int) -> Column:
    return F.substring(text, start, length).cast("int")


def _day_parts(kind: Column, text: Column) -> tuple[Column, Column, Column]:
    """Year, month and day; with a slash the month comes first, unless it can't."""
    ymd, us = kind == "ymd", (F.substring(text, 3, 1) == "/") & ~kind.isin("late", "leap")
    month = F.when(ymd, _part(text, 6, 2)).when(us, _part(text, 1, 2)).otherwise(_part(text, 4, 2))
    day = F.when(ymd, _part(text, 9, 2)).when(us, _part(text, 4, 2)).otherwise(_part(text, 1, 2))
    return F.when(ymd, _part(text, 1, 4)).otherwise(_part(text, 7, 4)), month, day


def _ten(digits: Column) -> Column:
    return F.pow(F.lit(10.0), digits).cast("bigint")


def _place(hit: Column) -> Column:
    """The value of a candidate in its domain, with the domain's sizes; a null
    value if the candidate fails its check."""
    text, kind = hit["text"], hit["kind"]
    digits = F.regexp_replace(text, "[^0-9]", "")
    count = F.length(digits)
    year, month, day = _day_parts(kind, text)
    octets = F.transform(F.split(text, r"\."), lambda o: o.cast("bigint"))
    ip = F.when(F.forall(octets, lambda o: o <= 255), F.aggregate(octets, F.lit(0).cast("bigint"), lambda n, o: n * 256 + o))
    first = F.when((year >= FIRST_YEAR) & (year <= LAST_YEAR) & (month >= 1) & (month <= 12), F.make_date(year, month, F.lit(1)))
    date = F.when((day >= 1) & (day <= F.dayofmonth(F.last_day(first))), F.datediff(F.date_add(first, day - 1), F.lit(f"{FIRST_YEAR}-01-01").cast("date")).cast("bigint"))
    area, group, serial = _part(digits, 1, 3), _part(digits, 4, 2), _part(digits, 6, 4)
    area_number = F.when((area >= 1) & (area <= 899) & (area != 666), F.when(area > 666, area - 2).otherwise(area - 1))
    ssn = F.when((group >= 1) & (serial >= 1), (area_number.cast("bigint") * 99 + group - 1) * 9999 + serial - 1)
    # Of a national number, what stands after its prefix changes; else the last digits.
    own = F.when(text.rlike(f"^(?:{_PAIRS})$"), F.lit(8)).when(text.rlike(f"^{_AREA}$"), F.length(F.regexp_extract(text, "[0-9]+$", 0))).when(count >= 10, F.lit(10)).otherwise(F.lit(7))
    phone = F.when((count >= 8) & (count <= 15), F.substr(digits, count - own + 1, own).cast("bigint"))
    card = F.when(_luhn(digits), F.substr(digits, F.lit(1), count - 1).cast("bigint"))
    is_day = kind.isin("ymd", "dmy")
    place = F.get(F.array(*[F.lit(n) for n in LATER]), month - 1) + day - 13
    late = F.when(date.isNotNull(), ((year - FIRST_YEAR) * LATE_DAYS[1] + place).cast("bigint"))
    leap = F.when(date.isNotNull(), F.floor((year - FIRST_LEAP) / 4).cast("bigint"))
    half = F.when(kind == "card", F.floor((count - 1) / 2)).otherwise(F.floor(own / 2)).cast("int")
    rest = F.when(kind == "card", count - 1).otherwise(own) - half
    value = F.when(is_day, date).when(kind == "late", late).when(kind == "leap", leap).when(kind == "ip", ip).when(kind == "ssn", ssn).when(kind == "card", card).when(kind == "phone", phone).otherwise(F.lit(0).cast("bigint"))
    fixed = lambda i: F.when(is_day, F.lit(DAYS[i])).when(kind == "late", F.lit(LATE_DAYS[i])).when(kind == "leap", F.lit(LEAP_DAYS[i])).cast("bigint")
    any_day = kind.isin("ymd", "dmy", "late", "leap")
    size_a = F.when(any_day, fixed(0)).when(kind == "ip", F.lit(65536).cast("bigint")).when(kind == "ssn", F.lit(898 * 99).cast("bigint")).when(kind.isin("card", "phone"), _ten(half)).otherwise(F.lit(1).cast("bigint"))
    size_b = F.when(any_day, fixed(1)).when(kind == "ip", F.lit(65536).cast("bigint")).when(kind == "ssn", F.lit(9999).cast("bigint")).when(kind.isin("card", "phone"), _ten(rest)).otherwise(F.lit(1).cast("bigint"))
    return F.struct(text.alias("text"), kind.alias("kind"), digits.alias("digits"), own.alias("own"), value.alias("value"), size_a.alias("size_a"), size_b.alias("size_b"))


def _into(template: Column, digits: Column) -> Column:
    """The template with its digits replaced in order."""
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("at"))

    def step(s: Column, c: Column) -> Column:
        is_digit = (c >= "0") & (c <= "9")
        return F.struct(F.concat(s["out"], F.when(is_digit, F.substr(digits, s["at"], F.lit(1))).otherwise(c)).alias("out"), (s["at"] + F.when(is_digit, 1).otherwise(0)).alias("at"))

    return F.aggregate(F.split(template, ""), start, step, lambda s: s["out"])


def _write(hit: Column, key: str) -> Column:
    """The pseudonym for ``hit['to']``."""
    text, kind, digits, to = hit["text"], hit["kind"], hit["digits"], hit["to"]
    count = F.length(digits)
    mail = F.split(F.lower(text), "@")
    email = F.concat(F.lit("u"), F.substring(_secret(key, F.lit("local"), F.lower(text)), 1, 12), F.lit("@d"), F.substring(_secret(key, F.lit("domain"), F.element_at(mail, 2)), 1, 8), F.lit(".example.com"))
    day = F.date_add(F.lit(f"{FIRST_YEAR}-01-01").cast("date"), to.cast("int"))
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    us = F.substring(text, 3, 1) == "/"
    ymd = F.concat(F.lpad(F.year(day).cast("string"), 4, "0"), two(F.month(day)), two(F.dayofmonth(day)))
    dmy = F.concat(F.when(us, two(F.month(day))).otherwise(two(F.dayofmonth(day))), F.when(us, two(F.dayofmonth(day))).otherwise(two(F.month(day))), F.lpad(F.year(day).cast("string"), 4, "0"))
    months = F.array(*[F.lit(n) for n in LATER])
    spare = to % LATE_DAYS[1]
    month = F.size(F.filter(months, lambda n: n <= spare))
    late = F.concat(two(spare - F.get(months, month - 1) + 13), two(month), (F.floor(to / LATE_DAYS[1]) + FIRST_YEAR).cast("string"))
    leap = F.concat(F.lit("2902"), (to * 4 + FIRST_LEAP).cast("string"))
    octet = lambda shift: F.shiftright(to, shift).bitwiseAND(F.lit(255).cast("bigint")).cast("string")
    ip = F.concat_ws(".", octet(24), octet(16), octet(8), octet(0))
    parts = F.floor(to / 9999).cast("bigint")
    area = F.floor(parts / 99).cast("bigint") + 1
    ssn = F.concat(F.lpad(F.when(area >= 666, area + 1).otherwise(area).cast("string"), 3, "0"), two(parts % 99 + 1), F.lpad((to % 9999 + 1).cast("string"), 4, "0"))
    phone = F.concat(F.substr(digits, F.lit(1), count - hit["own"]), F.lpad(to.cast("string"), hit["own"], F.lit("0")))
    body = F.lpad(to.cast("string"), count - 1, F.lit("0"))
    card = F.concat(body, F.element_at(F.filter(F.sequence(F.lit(0), F.lit(9)), lambda c: _luhn(F.concat(body, c.cast("string")))), 1).cast("string"))
    new = F.when(kind == "ymd", ymd).when(kind == "dmy", dmy).when(kind == "late", late).when(kind == "leap", leap).when(kind == "ssn", ssn).when(kind == "phone", phone).otherwise(card)
    return F.when(to.isNull(), text).when(kind == "email", email).when(kind == "ip", ip).otherwise(_into(text, new))


def pseudonymize(docs: DataFrame, text_col: str = "text", key: str = KEY, counts: bool = False) -> DataFrame:
    """``docs`` with pseudonyms in ``text_col``; ``counts`` adds ``n_<kind>`` for
    each kind, the number of values replaced."""
    text = F.col(f"`{text_col}`")
    found = F.when(text.rlike("[0-9@]"), F.regexp_extract_all(text, F.lit(_ANY), F.lit(0)))
    hits = F.transform(F.transform(found, lambda m: F.struct(m.alias("text"), _kind(m).alias("kind"))), _place)
    tweak = lambda h: F.when(h["kind"].isin("ymd", "dmy"), "date").otherwise(F.concat_ws(":", h["kind"], F.when(h["kind"] == "card", F.length(h["digits"])), F.when(h["kind"] == "phone", h["own"])))
    hits = F.transform(hits, lambda h: F.struct(h["text"].alias("text"), h["kind"].alias("kind"), h["digits"].alias("digits"), h["own"].alias("own"), feistel(h["value"], h["size_a"], h["size_b"], tweak(h), key).alias("to")))
    hits = F.transform(hits, lambda h: F.struct(F.when(h["to"].isNotNull(), F.when(h["kind"].isin("ymd", "dmy", "late", "leap"), "date").otherwise(h["kind"])).alias("kind"), _write(h, key).alias("to")))
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), hits.alias("hits"))
    text = F.col(f"row.`{text_col}`")
    between = F.split(text, _ANY, -1)
    new = F.when(F.size("hits") > 0, F.concat(F.array_join(F.zip_with(F.slice(between, 1, F.size("hits")), "hits", lambda t, h: F.concat(t, h["to"])), ""), F.element_at(between, -1))).otherwise(text)
    of_kind = lambda kind: F.size(F.filter("hits", lambda h: h["kind"] == kind))
    added = [F.coalesce(of_kind(k), F.lit(0)).cast("bigint").alias(f"n_{k}") for k in KINDS] if counts else []
    names = {f"n_{k}" for k in KINDS} if counts else set()
    return row.select(*[new.alias(c) if c == text_col else F.col(f"row.`{c}`") for c in docs.columns if c not in names], *added)


def query(spark, sf_dir: str) -> DataFrame:
    """(doc_id, text, n_email, n_date, n_ip, n_ssn, n_phone, n_card): the whole
    rewritten text, and how many values of each kind were replaced."""
    return pseudonymize(load(spark, sf_dir, "documents").select("doc_id", "text"), counts=True)
