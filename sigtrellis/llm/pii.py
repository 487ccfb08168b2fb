"""Format-preserving pseudonyms for personal data, by DataFrame operations only.

Validated numbers (cards by the Luhn digit, IBANs by mod 97, North American phone
and social security numbers, IPv4 addresses), dates of the calendar, e-mail
addresses and hexadecimal secrets are found in whole texts and replaced. Each kind
becomes a list of symbols with a radix for each; eight rounds of a keyed Feistel
network over mixed radices permute that list within its format:

* digits move among digits and letters among letters; separators stay in place,
* check digits are computed anew, so that a card stays a valid card,
* a date moves within the 146,097 days from 1800 to 2199 (189 x 773, so that every
  pseudonym is a date) and is written as it was.

The network sees the bare value (digits without separators, the day, not its
notation), so equal values stay linked in all documents whatever their writing.
Text that fails validation stays as it is.

A number that another one follows is found without it: four groups of four digits, or
the first groups of an IBAN, are tried by themselves where the whole run isn't valid.

Null text stays null with counts of 0; empty text stays empty. Repeated rows get
the same pseudonyms, and an empty table gives an empty result. Columns other than the
text stay, except that one of the result's name is replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8
#: Days from 1800-01-01 on: one full cycle of the calendar, 189 * 773.
FIRST_DAY, DAYS = "1800-01-01", (189, 773)
#: What is looked for, the first that matches at a place wins. (?<!...) and (?!...) keep parts of longer numbers out.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,24}(?![A-Za-z0-9])",
    # in one case; an IBAN of Andorra could be read as one, too
    "secret": r"(?<![A-Za-z0-9])(?:(?=[0-9]*[a-f])(?=[a-f]*[0-9])[0-9a-f]{24,64}|(?!AD[0-9]{10}[0-9A-F]{12}(?![A-Za-z0-9]))(?=[0-9]*[A-F])(?=[A-F]*[0-9])[0-9A-F]{24,64})(?![A-Za-z0-9])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "date": r"(?<![0-9./-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}|[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{4})(?![0-9]|[./-][0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9]|-[0-9])",
    # behind +1 and in brackets, any area code
    "phone": r"(?<![0-9A-Za-z+])(?:\+1[ .-]?\([0-9]{3}\) ?[0-9]{3}|(?:\+?1[ .-]?)?(?:\([2-9][0-9]{2}\) ?|[2-9][0-9]{2}[ .-])[2-9][0-9]{2})[ .-][0-9]{4}(?![0-9]|-[0-9])",
    "ip": r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9]|\.[0-9])",
    # unbroken; by fours, with up to three digits more, which may be another number; in any other groups
    "card": r"(?<![0-9])(?:[0-9]{13,19}(?![0-9])|(?:[0-9]{4}[ -]){3}[0-9]{4}(?:[ -][0-9]{1,3}(?![0-9]|[ ./-][0-9]))?(?![0-9])|[0-9](?:[ -]?[0-9]){12,18}(?![0-9]|[ -][0-9]))",
}
_ANY = "|".join(PATTERNS.values())


def _let(value: Column, body) -> Column:
    """body(value), with value evaluated once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def feistel(symbols: Column, radices: Column, key: str, tweak: str) -> Column:
    """A keyed permutation of lists of symbols (array<int>, each below its radix); undone by running it backwards."""
    half = F.floor(F.size(symbols) / 2).cast("int")

    def moved(side: Column, other: Column, radix: Column, turn: Column) -> Column:
        seed = F.sha2(F.concat_ws("|", F.lit(key), F.lit(tweak), turn.cast("string"), F.array_join(F.transform(other, lambda v: v.cast("string")), ",")), 512)

        def shift(digest: Column) -> Column:
            part = lambda i: F.conv(F.substr(digest, (i % 16) * 8 + 1, F.lit(8)), 16, 10).cast("long")
            return F.transform(side, lambda v, i: F.pmod(v + part(i) + F.floor(i / 16) * 7, F.get(radix, i)).cast("int"))

        return _let(seed, shift)

    low = lambda a: F.slice(a, F.lit(1), half)
    high = lambda a: F.slice(a, half + 1, F.size(symbols))

    def turn(s: Column, i: Column) -> Column:
        even = i % 2 == 0
        return F.struct(
            F.when(even, moved(s["l"], s["r"], low(radices), i)).otherwise(s["l"]).alias("l"),
            F.when(even, s["r"]).otherwise(moved(s["r"], s["l"], high(radices), i)).alias("r"),
        )

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), F.struct(low(symbols).alias("l"), high(symbols).alias("r")), turn, lambda s: F.concat(s["l"], s["r"]))


def _digits(text: Column) -> Column:
    """Characters 0-9 as an array of int."""
    return F.transform(F.split(text, ""), lambda c: c.cast("int"))


def _join(digits: Column) -> Column:
    return F.array_join(F.transform(digits, lambda d: d.cast("string")), "")


def _refill(written: Column, values: Column, chars: str) -> Column:
    """written, with its characters of a class replaced in turn by those of values."""

    def step(s: Column, c: Column) -> Column:
        hit = F.rlike(c, F.lit(chars))
        return F.struct(F.concat(s["out"], F.when(hit, F.substr(values, s["at"] + 1, F.lit(1))).otherwise(c)).alias("out"), (s["at"] + hit.cast("int")).alias("at"))

    return F.aggregate(F.split(written, ""), F.struct(F.lit("").alias("out"), F.lit(0).alias("at")), step, lambda s: s["out"])


def luhn(digits: Column) -> Column:
    """The check digit that follows the digits."""
    n = F.size(digits)
    doubled = F.transform(digits, lambda d, i: F.when((n - i) % 2 == 1, F.when(d > 4, d * 2 - 9).otherwise(d * 2)).otherwise(d))
    return (F.lit(10) - F.aggregate(doubled, F.lit(0), lambda s, d: s + d) % 10) % 10


def _alnum(text: Column, key: str, tweak: str, hexadecimal: bool = False) -> Column:
    """Digits among digits, letters among letters of their case; anything else stays."""
    code = lambda c: F.ascii(c)
    if hexadecimal:
        value = F.transform(F.split(text, ""), lambda c: F.conv(c, 16, 10).cast("int"))
        new = F.array_join(F.transform(feistel(value, F.transform(value, lambda _: F.lit(16)), key, tweak), lambda v: F.conv(v.cast("string"), 10, 16)), "")
        return F.when(F.rlike(text, F.lit("[A-F]")), F.upper(new)).otherwise(F.lower(new))
    base = lambda c: F.when(c.between("0", "9"), 48).when(c.between("a", "z"), 97).when(c.between("A", "Z"), 65)
    chars = F.split(text, "")
    value = F.transform(chars, lambda c: F.coalesce(code(c) - base(c), F.lit(0)))
    radix = F.transform(chars, lambda c: F.when(base(c) == 48, 10).when(base(c).isNotNull(), 26).otherwise(1))
    new = feistel(value, radix, key, tweak)
    return F.array_join(F.transform(chars, lambda c, i: F.when(base(c).isNotNull(), F.char(base(c) + F.get(new, i))).otherwise(c)), "")


def _card(m: Column, key: str) -> Column:
    """Four groups of four if they are a card, whatever follows them, otherwise the whole match."""
    digits = lambda x: _digits(F.regexp_replace(x, "[^0-9]", ""))
    valid = lambda d: luhn(F.slice(d, F.lit(1), F.size(d) - 1)) == F.element_at(d, -1)
    runs = F.array(F.regexp_extract(m, "^(?:[0-9]{4}[ -]){3}[0-9]{4}(?=[ -])", 0), m)
    card = F.get(F.filter(runs, lambda x: (x != "") & valid(digits(x))), 0)

    def swap(x: Column) -> Column:
        body = F.slice(digits(x), F.lit(1), F.size(digits(x)) - 1)
        new = feistel(body, F.transform(body, lambda _: F.lit(10)), key, "card")
        made = _let(new, lambda b: _refill(x, _join(F.concat(b, F.array(luhn(b)))), "[0-9]"))
        return F.when(x.isNotNull(), F.concat(made, F.substr(m, F.length(x) + 1)))

    return _let(card, swap)


def _mod97(text: Column) -> Column:
    return F.aggregate(F.split(text, ""), F.lit(0), lambda s, c: F.when(c.between("0", "9"), (s * 10 + F.ascii(c) - 48) % 97).otherwise((s * 100 + F.ascii(c) - 55) % 97))


def _iban(m: Column, key: str) -> Column:
    """The longest run of groups from the first that is valid; words or numbers behind it stay."""
    groups = F.split(m, " ")
    runs = F.transform(F.sequence(F.size(groups), F.lit(1), F.lit(-1)), lambda n: F.array_join(F.slice(groups, F.lit(1), n), " "))
    bare = lambda x: F.replace(x, F.lit(" "), F.lit(""))
    valid = lambda b: (F.length(b) >= 12) & (_mod97(F.concat(F.substr(b, F.lit(5)), F.substr(b, F.lit(1), F.lit(4)))) == 1)
    iban = F.get(F.filter(runs, lambda x: valid(bare(x))), 0)

    def swap(x: Column) -> Column:
        country = F.substr(x, F.lit(1), F.lit(2))
        account = _alnum(F.substr(bare(x), F.lit(5)), key, "iban")
        made = _let(account, lambda a: F.concat(country, F.lpad((F.lit(98) - _mod97(F.concat(a, country, F.lit("00")))).cast("string"), 2, "0"), a))
        return F.when(x.isNotNull(), F.concat(_refill(x, made, "[0-9A-Z]"), F.substr(m, F.length(x) + 1)))

    return _let(iban, swap)


def _phone(m: Column, key: str) -> Column:
    bare = F.regexp_replace(m, "[^0-9]", "")
    # area code and exchange start with 2-9; where they start with 0 or 1 they keep doing so
    least = lambda d: F.when(d < 2, 0).otherwise(2)

    def swap(ten: Column) -> Column:
        start = F.transform(ten, lambda d, i: F.when(i.isin(0, 3), d - least(d)).otherwise(d))
        radices = F.transform(ten, lambda d, i: F.when(i.isin(0, 3), F.when(d < 2, 2).otherwise(8)).otherwise(10))
        return F.transform(feistel(start, radices, key, "phone"), lambda d, i: F.when(i.isin(0, 3), d + least(F.get(ten, i))).otherwise(d))

    new = _join(_let(_digits(F.right(bare, F.lit(10))), swap))
    return _refill(m, F.concat(F.when(F.length(bare) > 10, F.substr(bare, F.lit(1), F.length(bare) - 10)).otherwise(""), new), "[0-9]")


def _ssn(m: Column, key: str) -> Column:
    area, group, serial = (F.substr(m, F.lit(a), F.lit(n)).cast("int") for a, n in ((1, 3), (5, 2), (8, 4)))
    valid = area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)
    symbols = F.array(area - F.when(area > 666, 2).otherwise(1), group - 1, serial - 1)
    new = feistel(symbols, F.array(F.lit(898), F.lit(99), F.lit(9999)), key, "ssn")
    pad = lambda v, n: F.lpad(v.cast("string"), n, "0")
    return F.when(valid, _let(new, lambda x: F.concat_ws("-", pad(F.get(x, 0) + F.when(F.get(x, 0) >= 665, 2).otherwise(1), 3), pad(F.get(x, 1) + 1, 2), pad(F.get(x, 2) + 1, 4))))


def _ip(m: Column, key: str) -> Column:
    parts = F.transform(F.split(m, r"\."), lambda p: p.cast("int"))
    return F.when(F.array_max(parts) < 256, F.array_join(F.transform(feistel(parts, F.array(*[F.lit(256)] * 4), key, "ip"), lambda p: p.cast("string")), "."))


def _date(m: Column, key: str) -> Column:
    parts = F.split(m, "[-/.]")
    iso, slash = F.contains(m, F.lit("-")), F.contains(m, F.lit("/"))
    a, b, c = (F.get(parts, i).cast("int") for i in range(3))
    # with slashes the month comes first, unless only the other reading is a date
    month_first = slash & (a <= 12)
    year, month, day = F.when(iso, a).otherwise(c), F.when(iso | (slash & ~month_first), b).when(month_first, a).otherwise(b), F.when(iso, c).when(month_first, b).otherwise(a)

    def swap(ymd: Column) -> Column:
        y, mo, d = (F.get(ymd, i) for i in range(3))
        safe = F.make_date(F.greatest(F.least(y, F.lit(2199)), F.lit(1800)), F.greatest(F.least(mo, F.lit(12)), F.lit(1)), F.lit(1))
        valid = y.between(1800, 2199) & mo.between(1, 12) & d.between(1, F.day(F.last_day(safe)))
        number = F.datediff(F.date_add(safe, d - 1), F.lit(FIRST_DAY).cast("date"))
        new = feistel(F.array(F.floor(number / DAYS[1]).cast("int"), number % DAYS[1]), F.array(*[F.lit(x) for x in DAYS]), key, "date")
        when = lambda x: F.date_add(F.lit(FIRST_DAY).cast("date"), F.get(x, 0) * DAYS[1] + F.get(x, 1))
        wide = F.length(F.get(parts, 0)) == 2

        def write(t: Column) -> Column:
            two = lambda v: F.lpad(v.cast("string"), 2, "0")
            short = lambda v, i: F.when(F.length(F.get(parts, i)) == 2, two(v)).otherwise(v.cast("string"))
            first = F.when(month_first, F.month(t)).otherwise(F.day(t))
            second = F.when(month_first, F.day(t)).otherwise(F.month(t))
            mark = F.when(slash, "/").otherwise(".")
            return F.when(iso, F.date_format(t, "yyyy-MM-dd")).otherwise(F.concat(F.when(wide, two(first)).otherwise(first.cast("string")), mark, short(second, 1), mark, F.lpad(F.year(t).cast("string"), 4, "0")))

        return F.when(valid, _let(_let(new, when), write))

    return _let(F.array(year, month, day), swap)


def _email(m: Column, key: str) -> Column:
    top = F.substring_index(m, ".", -1)
    rest = F.substr(m, F.lit(1), F.length(m) - F.length(top))
    return F.concat(_alnum(rest, key, "email"), top)


def pseudonym(m: Column, key: str) -> Column:
    """struct(kind, new) of one match; both null if it isn't valid."""
    makers = {"email": _email, "secret": lambda x, k: _alnum(x, k, "secret", True), "iban": _iban, "date": _date, "ssn": _ssn, "phone": _phone, "ip": _ip, "card": _card}
    named, choice = None, None
    for kind, make in makers.items():
        test = F.rlike(m, F.lit(f"^(?:{PATTERNS[kind]})$"))
        named = F.when(test, kind) if named is None else named.when(test, kind)
        choice = F.when(test, make(m, key)) if choice is None else choice.when(test, make(m, key))
    return _let(choice, lambda new: F.struct(F.when(new.isNotNull(), named).alias("kind"), new.alias("new")))


def pseudonymise(docs: DataFrame, key: str, text_col: str = "text", out: str = "pii") -> DataFrame:
    """docs with one more column: struct of text (with pseudonyms) and found (array of kind, old, new)."""
    text = F.col(text_col).cast("string")
    held, new = (next(n for n in (f"_{what}{i or ''}" for i in range(len(docs.columns) + 1)) if n not in docs.columns) for what in ("matches", "found"))
    matches = F.when(F.rlike(text, F.lit("[0-9@]")), F.regexp_extract_all(text, F.lit(_ANY), F.lit(0)))
    packed = docs.withColumn(held, matches)
    found = F.transform(held, lambda m: _let(pseudonym(m, key), lambda p: F.struct(p["kind"].alias("kind"), m.alias("old"), p["new"].alias("new"))))
    packed = packed.withColumn(new, F.when(F.size(held) > 0, found))
    gaps = F.split(text, _ANY, -1)
    joined = F.array_join(F.transform(gaps, lambda g, i: F.concat(g, F.coalesce(F.get(new, i)["new"], F.get(new, i)["old"], F.lit("")))), "")
    kept = F.filter(F.coalesce(new, F.array().cast("array<struct<kind:string,old:string,new:string>>")), lambda x: x["kind"].isNotNull())
    result = F.struct(F.when(F.col(new).isNotNull(), joined).otherwise(text).alias("text"), kept.alias("found"))
    return packed.withColumn(out, result).drop(held, new)


def report(docs: DataFrame, key: str) -> DataFrame:
    """doc_id, text (with pseudonyms), n_numbers, n_dates, n_others (addresses and secrets), kinds (sorted)."""
    out = pseudonymise(docs.select("doc_id", "text"), key)
    n = lambda test: F.size(F.filter("pii.found", lambda x: test(x["kind"]))).cast("long")
    return out.select(
        "doc_id",
        F.col("pii.text").alias("text"),
        n(lambda k: k.isin("card", "iban", "ssn", "phone", "ip")).alias("n_numbers"),
        n(lambda k: k == "date").alias("n_dates"),
        n(lambda k: k.isin("email", "secret")).alias("n_others"),
        F.concat_ws(",", F.array_sort(F.array_distinct(F.transform("pii.found", lambda x: x["kind"])))).alias("kinds"),
    )
