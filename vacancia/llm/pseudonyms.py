"""Format-preserving pseudonyms for personal data, in Spark functions only.

Values are found by pattern and validated (Luhn digit, octets, calendar, number
plan). A number or a date is an index into a product domain; an alternating
Feistel network with a keyed hash permutes that domain, so equal values get
equal pseudonyms in all documents, different ones different pseudonyms, and
whoever holds the key can walk back. Mail names and secrets are no numbers:
they become keyed digests in the same alphabet.

| kind | format kept | domain |
|---|---|---|
| card | length, separators, first digit, valid Luhn digit | the digits between |
| phone (national, or international after a +) | country code, separators | the other digits |
| social security number | separators, valid area, group and serial | 898 x 99 x 9999 |
| IPv4 | dotted octets | 2^16 x 2^16 |
| date (2024-01-31, 2024/01/31, 31.01.2024, 01/31/2024) | layout, valid date | the days of its era |
| date (31/01/2024) | layout, valid date, a day above 12 | such days of its era |
| mail address | the host | keyed digest for the name |
| access key, token, password | prefix, length, case | keyed digest |

An era is a cycle of 400 years (200-599, ..., 1800-2199, ...), or what is left of
one at either end of the years 1 to 9999, so that dates keep four digits for the year.
A date like 01/02/2024 is read with the month first. The value of a token or
password is of any length; without quotes it ends before white space, quotes,
brackets, `,`, `;` or `&`.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

ROUNDS = 10
_FIRST_YEAR = 1800  # of a cycle; days and months are counted from there
_FIRST_DAY = f"{_FIRST_YEAR}-01-01"
# First year, years and days (in two factors) of the eras that are no full cycles, then of a full cycle;
# the same for days of the month above 12 alone.
_DAYS = ((1, 199, 13, 5591), (9800, 200, 184, 397), (None, 400, 189, 773))
_LATE_DAYS = ((1, 100, 4, 5531), (101, 99, 147, 149), (9800, 200, 8, 5531), (None, 400, 9, 9833))

_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
# Repeated groups of open number are possessive: only these are matched without recursion, so no text fills the stack.
_MAIL = r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@[\p{L}\p{N}-]++(?:\.[\p{L}\p{N}-]++)++"
_SECRET_NAME = r"(?i:token|password|passwd|secret|api_key|apikey)\s?[=:]\s?"
_SECRET = _SECRET_NAME + r"[\"']?"
_SECRET_VALUE = r"[^\s\"'<>()\[\]{},;&]*[^\s\"'<>()\[\]{},;&.!?:]"
_KEY = r"(?<![\p{L}\p{N}])(?:AKIA|ASIA)[0-9A-Z]{16}(?![\p{L}\p{N}])"
# What follows a phone number after a blank and is a value of its own.
_APART = (r"\d{1,3}(?:\.\d{1,3}){3}(?!\p{N}|\.\p{N})|\d{4}-\d\d-\d\d(?!\p{N})|\d\d\.\d\d\.\d{4}(?!\p{N})"
          r"|\d{4}/\d\d/|\d\d/\d\d/|\d{3}-\d\d-\d{4}(?!\p{N})")
_CARD = r"\d{4}[ -]\d{4}[ -]\d{4}[ -]\d{4}(?!\p{N}|[ -]\d{4}(?!\p{N}))|\d{4}[ -]\d{6}[ -]\d{5}(?!\p{N})"
_NATIONAL = r"(?:\d{1,3}[ .-])?\d{3}[ .-]\d{3}[ .-]\d{4}(?!\p{N})"
_NATIONAL_ONLY = r"\d{3}[ .-]\d{3}[ .-]\d{4}$"
_CODE = r"1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3}"  # country codes, none begins another
_NUMBERS = "|".join((
    r"\d{1,3}(?:\.\d{1,3}){3}(?!\p{N}|\.\p{N})",
    r"\d{4}-\d\d-\d\d(?!\p{N})", r"\d{4}/\d\d/\d\d(?!\p{N})",
    r"\d\d\.\d\d\.\d{4}(?!\p{N})", r"\d\d/\d\d/\d{4}(?!\p{N})",
    r"\d{3}-\d\d-\d{4}(?!\p{N}|-\p{N})",
    r"\+?\d{1,3}[ .-]?\(\d{2,4}\)[ .-]?\d{3,4}[ .-]?\d{3,4}(?!\p{N})",
    r"(?:\+?\d{1,3}[ .-])?(?:\(\d{3}\)[ .-]?|\d{3}[ .-])\d{3}[ .-]\d{4}(?!\p{N})",
    r"\+[1-9]\d{0,2}[ .-]?\(\d{1,4}\)(?:[ .-]?\d){6,10}(?!\p{N})",
    rf"\+(?!\d{{1,3}} (?:{_CARD}))[1-9](?:(?:[.-]| (?!{_APART}))?\d){{7}}"
    rf"(?:(?:[.-]| (?!{_APART}|{_CARD}|{_NATIONAL}))?\d){{0,7}}(?!\p{{N}})",
    r"\d{13,19}(?!\p{N})", r"\d{4}([ -])\d{4}\1\d{4}\1\d{1,7}(?!\p{N})",
    r"\d{4}[ -]\d{6}[ -]\d{5}(?!\p{N})"))
PATTERN = (rf"{_MAIL}|(?<!\p{{N}})(?<!\p{{N}}[.+-])(?=[\d+(])(?:{_NUMBERS})|{_KEY}"
           rf"|{_SECRET_NAME}(?:\"[^\"\r\n]++(?=\")|'[^'\r\n]++(?=')|[\"']?{_SECRET_VALUE})")


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value worked out once however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _hash(key: str, *parts: Column) -> Column:
    return F.sha2(F.concat_ws(":", F.lit(key), *[p.cast("string") for p in parts]), 256)


def _number(key: str, *parts: Column) -> Column:
    """A keyed 60-bit number."""
    return F.conv(F.substring(_hash(key, *parts), 1, 15), 16, 10).cast("long")


def feistel(left: Column, right: Column, a: Column, b: Column, kind: str, key: str,
            back: bool = False) -> Column:
    """Permute the pairs (left, right) of 0..a-1 x 0..b-1; struct of left and right.

    Rounds add a keyed hash of one half to the other, modulo its size; `back`
    takes them away in reverse order.
    """
    sign = -1 if back else 1
    rounds = list(range(ROUNDS))[::-1 if back else 1]

    def run(size: Column) -> Column:
        start = F.struct(left.cast("long").alias("left"), right.cast("long").alias("right"))

        def step(s: Column, i: Column) -> Column:
            def moved(half: str, other: str, n: Column) -> Column:
                noise = _number(key, F.lit(kind), size["a"], size["b"], i, s[other])
                return F.pmod(s[half] + sign * (noise % n), n).alias(half)
            return F.when(i % 2 == 0, F.struct(moved("left", "right", size["a"]), s["right"])
                          ).otherwise(F.struct(s["left"], moved("right", "left", size["b"])))

        return F.aggregate(F.array(*map(F.lit, rounds)), start, step)

    return _let(F.struct(a.cast("long").alias("a"), b.cast("long").alias("b")), run)


def _power(n: Column) -> Column:
    return F.pow(F.lit(10.0), n).cast("long")


def permute_digits(digits: Column, kind: str, key: str, back: bool = False) -> Column:
    """A permutation of the digit strings of each length from 2 to 18."""
    def run(d: Column) -> Column:
        u = F.ceil(F.length(d) / 2).cast("int")
        v = F.length(d) - u
        pair = feistel(F.substring(d, F.lit(1), u).cast("long"), F.substring(d, u + 1, v).cast("long"),
                       _power(u), _power(v), kind, key, back)
        return _let(pair, lambda p: F.concat(F.lpad(p["left"].cast("string"), u, "0"),
                                             F.lpad(p["right"].cast("string"), v, "0")))
    return _let(digits, run)


def luhn_sum(digits: Column) -> Column:
    """The weighted digit sum; a valid number's is divisible by 10."""
    def run(d: Column) -> Column:
        def step(total: Column, i: Column) -> Column:
            x = F.substring(d, F.length(d) - i + 1, F.lit(1)).cast("int")
            twice = F.when(x > 4, 2 * x - 9).otherwise(2 * x)
            return total + F.when(i % 2 == 0, twice).otherwise(x)
        return F.aggregate(F.sequence(F.lit(1), F.length(d)), F.lit(0), step)
    return _let(digits, run)


def _lay_out(layout: Column, digits: Column) -> Column:
    """The layout with its digits replaced in order."""
    def run(d: Column) -> Column:
        start = F.struct(F.lit("").alias("out"), F.lit(1).alias("at"))

        def step(s: Column, c: Column) -> Column:
            return F.when(c.between("0", "9"), F.struct(
                F.concat(s["out"], F.substring(d, s["at"], F.lit(1))).alias("out"),
                (s["at"] + 1).alias("at"))).otherwise(
                    F.struct(F.concat(s["out"], c).alias("out"), s["at"].alias("at")))
        return F.aggregate(F.split(layout, ""), start, step)["out"]
    return _let(digits, run)


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, r"[^0-9]", "")


def card(m: Column, key: str, back: bool = False) -> Column:
    def run(d: Column) -> Column:
        middle = permute_digits(F.substring(d, F.lit(2), F.length(d) - 2), "card", key, back)
        return _let(F.concat(F.substring(d, 1, 1), middle), lambda body: F.concat(
            body, F.pmod(-luhn_sum(F.concat(body, F.lit("0"))), F.lit(10)).cast("string")))
    return _lay_out(m, _let(_digits(m), run))


def phone(m: Column, key: str, back: bool = False) -> Column:
    code = F.length(_digits(F.regexp_extract(
        m, rf"^\+?\d{{1,3}}[ .-]?(?=\()|^\+\d{{1,3}}(?=[ .-])|^\+(?:{_CODE})|^\d{{1,3}}[ .-](?={_NATIONAL_ONLY})", 0)))
    parts = F.struct(_digits(m).alias("all"), code.alias("code"))
    return _lay_out(m, _let(parts, lambda p: F.concat(
        F.substring(p["all"], F.lit(1), p["code"]), permute_digits(
            F.substring(p["all"], p["code"] + 1, F.length(p["all"])), "phone", key, back))))


def social(m: Column, key: str, back: bool = False) -> Column:
    """Areas 001-665 and 667-899, groups 01-99, serials 0001-9999, as one index."""
    area, group, serial = (F.regexp_extract(m, r"(\d{3})-(\d\d)-(\d{4})", i).cast("long")
                           for i in (1, 2, 3))
    index = area - F.when(area > 666, 2).otherwise(1)

    def show(p: Column) -> Column:
        index = F.floor(p["left"] / 99)
        return F.format_string("%03d-%02d-%04d", index + F.when(index >= 665, 2).otherwise(1),
                               p["left"] % 99 + 1, p["right"] + 1)

    return _let(feistel(index * 99 + group - 1, serial - 1, F.lit(898 * 99), F.lit(9999),
                        "social", key, back), show)


def address(m: Column, key: str, back: bool = False) -> Column:
    def run(o: Column) -> Column:
        return _let(feistel(o[0] * 256 + o[1], o[2] * 256 + o[3], F.lit(65536), F.lit(65536),
                            "address", key, back), lambda p: F.concat_ws(".", *[
                                x.cast("string") for half in (p["left"], p["right"])
                                for x in (F.floor(half / 256), half % 256)]))
    return _let(F.transform(F.split(m, r"\."), lambda x: x.cast("long")), run)


def _era(year: Column, eras) -> Column:
    """Struct of first (its first year), years, a and b of the era of a year."""
    def of(first: Column, years: int, a: int, b: int) -> Column:
        return F.struct(first.cast("int").alias("first"), F.lit(years).alias("years"), F.lit(a).alias("a"),
                        F.lit(b).alias("b"))
    *rest, cycle = eras
    out = F.when(F.lit(False), of(F.lit(1), *cycle[1:]))
    for first, years, a, b in rest:
        out = out.when(year.between(first, first + years - 1), of(F.lit(first), years, a, b))
    return out.otherwise(of(year - F.pmod(year - _FIRST_YEAR, F.lit(400)), *cycle[1:]))


def date(m: Column, layout: str, key: str, back: bool = False) -> Column:
    def run(day: Column) -> Column:
        def within(e: Column) -> Column:
            start = F.make_date(e["first"], F.lit(1), F.lit(1))
            pair = _let(F.datediff(day, start), lambda i: feistel(
                F.floor(i / e["b"]), i % e["b"], e["a"], e["b"], "date", key, back))
            return _let(pair, lambda p: F.date_format(F.date_add(
                start, (p["left"] * e["b"] + p["right"]).cast("int")), layout))
        return _let(_era(F.year(day), _DAYS), within)
    return _let(F.try_to_date(m, layout), run)


def _digest_like(value: Column, kind: str, key: str) -> Column:
    """As many keyed hex digits as the value has characters; upper case if it has no small letter."""
    long = F.concat(*[_hash(key, F.lit(f"{kind}{i}"), value) for i in range(4)])
    digest = F.rpad(F.substring(long, F.lit(1), F.least(F.length(value), F.lit(256))),
                    F.length(value), "0")
    return F.when(value == F.upper(value), F.upper(digest)).otherwise(digest)


def late_date(m: Column, key: str, back: bool = False) -> Column:
    """dd/MM/yyyy with a day above 12, permuted among such dates: so none is read with the month first."""
    origin = F.lit(_FIRST_DAY).cast("date")

    def before(month: Column) -> Column:
        """How many late days lie before a month, both counted from the origin."""
        return F.datediff(F.add_months(origin, month), origin) - 12 * month

    def run(day: Column) -> Column:
        def within(e: Column) -> Column:
            base = (e["first"] - _FIRST_YEAR) * 12
            month = (F.year(day) - _FIRST_YEAR) * 12 + F.month(day) - 1
            index = before(month) - before(base) + F.dayofmonth(day) - 13
            pair = _let(index, lambda i: feistel(
                F.floor(i / e["b"]), i % e["b"], e["a"], e["b"], "late date", key, back))

            def show(i: Column) -> Column:
                near = F.floor(i * e["years"] * 12 / (e["a"] * e["b"])).cast("int")
                found = F.array_max(F.filter(
                    F.sequence(F.greatest(near - 2, F.lit(0)), F.least(near + 2, e["years"] * 12 - 1)),
                    lambda n: before(base + n) - before(base) <= i))
                return _let(found, lambda n: F.date_format(F.date_add(
                    F.add_months(origin, base + n), (i - before(base + n) + before(base) + 12).cast("int")),
                    "dd/MM/yyyy"))
            return _let(pair, lambda p: _let((p["left"] * e["b"] + p["right"]).cast("int"), show))
        return _let(_era(F.year(day), _LATE_DAYS), within)

    return _let(F.try_to_date(m, "dd/MM/yyyy"), run)


_DATES = ((r"^\d{4}-\d\d-\d\d$", "yyyy-MM-dd"), (r"^\d{4}/\d\d/\d\d$", "yyyy/MM/dd"),
          (r"^\d\d\.\d\d\.\d{4}$", "dd.MM.yyyy"), (r"^\d\d/\d\d/\d{4}$", "MM/dd/yyyy"))


def pseudonym(m: Column, key: str, back: bool = False) -> Column:
    """The pseudonym of a found value; the value itself if it is not valid. `back` undoes numbers and dates."""
    d = _digits(m)
    plain = m.rlike(r"^[\d -]+$")
    area, group, serial = (F.regexp_extract(m, r"^(\d{3})-(\d\d)-(\d{4})$", i) for i in (1, 2, 3))
    valid_social = (m.rlike(r"^\d{3}-\d\d-\d{4}$") & ~area.isin("000", "666") & (area < "900")
                    & (group != "00") & (serial != "0000"))
    name = F.regexp_extract(m, f"^{_SECRET}", 0)
    value = F.substring(m, F.length(name) + 1, F.length(m))
    out = F.when(name != "", m if back else F.concat(name, _digest_like(value, "secret", key)))
    out = out.when(m.contains("@"), m if back else F.concat(
        F.lit("u"), F.substring(_hash(key, F.lit("mail"), F.lower(m)), 1, 15),
        F.regexp_extract(m, r"@.*$", 0)))
    out = out.when(m.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$"), address(m, key, back))
    for shape, layout in _DATES:
        out = out.when(m.rlike(shape) & F.try_to_date(m, layout).isNotNull(),
                       date(m, layout, key, back))
    out = out.when(m.rlike(r"^\d\d/\d\d/\d{4}$") & F.try_to_date(m, "dd/MM/yyyy").isNotNull(),
                   late_date(m, key, back))
    out = out.when(valid_social, social(m, key, back))
    out = out.when(plain & m.rlike(rf"^(?:\d{{1,3}}[ -])?{_NATIONAL_ONLY}"), phone(m, key, back))
    out = out.when(plain & F.length(d).between(13, 19) & (luhn_sum(d) % 10 == 0),
                   card(m, key, back))
    out = out.when(m.rlike(r"^[\d+(]") & m.rlike(r"[(+ .-]") & ~plain
                   & F.length(d).between(F.when(m.rlike(r"[+(]"), 8).otherwise(10), F.lit(15))
                   & ~m.rlike(r"^\d{1,3}(\.\d{1,3}){3}$"), phone(m, key, back))
    out = out.when(m.rlike(_KEY), m if back else F.concat(
        F.substring(m, 1, 4), _digest_like(F.substring(m, 5, 16), "key", key)))
    return out.otherwise(m)


def pseudonymize(df: DataFrame, key: str, text_col: str = "text",
                 count_col: str | None = "n_values") -> DataFrame:
    """All columns, the text with its personal data replaced, and how many values were replaced.

    The whole text is searched. A null text stays null with count 0, a text
    without personal data stays as it is. A column named like the count is
    replaced. Rows are neither moved nor dropped.
    """
    text = F.col(f"`{text_col}`")
    # Every value has a digit, an @ or a secret's name; other texts are not searched.
    found = F.when(text.rlike(f"[0-9@]|{_SECRET_NAME}"), F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0)))
    found = F.coalesce(found, F.array().cast("array<string>"))
    kept = df.columns if count_col is None else [c for c in df.columns if c != count_col]
    values, shown, between = "__values", "__shown", "__between"
    while {values, shown, between} & set(kept):
        values, shown, between = f"_{values}", f"_{shown}", f"_{between}"
    rows = df.select(*[F.col(f"`{c}`") for c in kept]).withColumn(values, found)
    rows = rows.withColumn(between, F.when(F.size(values) > 0, F.split(text, PATTERN, -1)))
    rows = rows.withColumn(shown, F.transform(values, lambda m: pseudonym(m, key)))
    changed = F.concat(F.array_join(F.zip_with(
        F.slice(F.col(between), F.lit(1), F.size(values)), F.col(shown), lambda part, p: F.concat(part, p)), ""),
        F.element_at(F.col(between), -1))
    rows = rows.withColumn(text_col, F.when(F.size(values) > 0, changed).otherwise(text))
    if count_col is not None:
        rows = rows.withColumn(count_col, F.size(F.filter(
            F.zip_with(values, shown, lambda m, p: m != p), lambda new: new)))
    return rows.drop(values, shown, between)
