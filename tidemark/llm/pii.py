"""Format-preserving Feistel pseudonyms for personal data, in DataFrame expressions only.

A validated value is permuted within its own format by a keyed Feistel network: the characters
are cut into two halves, and each round adds to one half, character by character and modulo the
size of the character's alphabet, a pad hashed from the key, the round and the other half. Every
round can be undone, so the map is a permutation of each format: equal values get equal
pseudonyms in every document, and different values stay different. Formats are such that every
pseudonym is valid by the rule that its value passed: check digits are made anew, and parts with
forbidden values (areas, groups and serials of social security numbers) are numbers of a range
without them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import fresh, table

ROUNDS = 10
#: The alphabets of a permuted character, by its class; characters of no class stay.
ALPHABETS = {
    "d": "0123456789",
    "n": "23456789",  # the first digits of North American area codes and exchanges
    "o": "01",  # the same where they are none of those
    "p": "123456789",  # the first digits of numbers without leading zeros
    "l": "abcdefghijklmnopqrstuvwxyz",
    "u": "ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "x": "0123456789abcdef",
    "X": "0123456789ABCDEF",
}


def _letters(first: int, last: int, small: bool) -> str:
    return "".join(c for c in map(chr, range(first, last + 1)) if (c.islower() if small else c.isupper()))


#: Letters of local parts beyond ASCII: accented Latin, Greek and Cyrillic, small and capital. Those of other scripts stay.
FOREIGN = {
    "a": _letters(0xC0, 0x17F, True),
    "A": _letters(0xC0, 0x17F, False),
    "g": _letters(0x391, 0x3CE, True),
    "G": _letters(0x391, 0x3CE, False),
    "c": _letters(0x400, 0x45F, True),
    "C": _letters(0x400, 0x45F, False),
}
#: Dates from 1900-01-01 to 2099-12-31: 73,049 days = 229 * 319.
FIRST_DAY, DAYS_A, DAYS_B = "1900-01-01", 229, 319

MONTHS = "January February March April May June July August September October November December".split()
#: Lengths of international account numbers by country.
IBAN_LENGTHS = {
    15: "NO",
    16: "BE",
    18: "DK FI FO GL NL SD",
    19: "MK SI",
    20: "AT BA EE KZ LT LU XK",
    21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA",
    23: "AE GI IL IQ TL",
    24: "AD CZ ES MD PK RO SA SE SK TN VG",
    25: "LY PT ST",
    26: "IS TR",
    27: "FR GR IT MC MR SM",
    28: "AL AZ BY CY DO GT HU LB PL SV",
    29: "BR EG PS QA UA",
    30: "JO KW MU",
    31: "MT SC",
    32: "LC",
}
#: The beginnings of country calling codes that have one digit or two; the others have three.
_CALLING = "1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]"


def _iban_pattern() -> str:
    """Each country's length, and any length for countries that are not listed."""
    of = []
    for n, countries in IBAN_LENGTHS.items():
        fours, rest = divmod(n - 4, 4)
        of.append(f"(?:{countries.replace(' ', '|')})[0-9]{{2}}(?: ?[A-Z0-9]{{4}}){{{fours}}}" + (f" ?[A-Z0-9]{{{rest}}}" if rest else ""))
    listed = "|".join(c for x in IBAN_LENGTHS.values() for c in x.split())
    of.append(f"(?!{listed})[A-Z]{{2}}[0-9]{{2}}(?: ?[A-Z0-9]{{4}}){{2,7}}(?: ?[A-Z0-9]{{1,3}})?")
    return rf"(?<![A-Za-z0-9])(?:{'|'.join(of)})(?![A-Za-z0-9])"


_MONTH = "(?:" + "|".join(dict.fromkeys([*MONTHS, *(m[:3] for m in MONTHS)])) + ")"

#: Published beginnings of secrets, and what follows each.
SECRETS = {
    "github_pat_": "[A-Za-z0-9_]{22,}",
    "gh[pousr]_": "[A-Za-z0-9]{30,}",
    "glpat-": "[A-Za-z0-9_-]{20,}",
    "xox[abeprs]-": "[A-Za-z0-9-]{10,}",
    "[spr]k_(?:live|test)_": "[A-Za-z0-9]{16,}",
    "sk-": "[A-Za-z0-9_-]{20,}",
    "AIza": "[A-Za-z0-9_-]{35}",
    "npm_": "[A-Za-z0-9]{36}",
    "eyJ": r"[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}",
}
_HEX = "[0-9A-Fa-f]{1,4}"
#: A dotted number after one of these words is no address.
_NUMBERED = "(?i:(?<![a-z])(?:v|ver|version|release|build|firmware|section|chapter|clause))"
#: Words that make nine digits a social security number.
_SSN_WORDS = r"(?i:SSN|social security(?: number| no\.?)?)(?: is)?[ :#=]{1,3}"

#: Kinds in the order in which they are tried; the first that fits at a place takes it.
PATTERNS = (
    ("email", r"(?<![\p{L}\p{M}\p{N}._%+-])[\p{L}\p{M}\p{N}._%+-]++@[\p{L}\p{N}-][\p{L}\p{M}\p{N}.-]*\.(?:xn--[A-Za-z0-9-]++|[\p{L}\p{M}]{2,}+)(?![\p{L}\p{N}])"),
    ("secret", rf"(?<![A-Za-z0-9_-])(?:{'|'.join(a + b for a, b in SECRETS.items())})(?![A-Za-z0-9_-])"),
    ("token", r"(?<![A-Za-z0-9])(?:[0-9a-f]{64}|[0-9a-f]{40}|[0-9a-f]{32}|[0-9A-F]{64}|[0-9A-F]{40}|[0-9A-F]{32})(?![A-Za-z0-9])"),
    ("access_key", r"(?<![A-Za-z0-9])(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9])"),
    ("iban", _iban_pattern()),
    # all eight groups, or the first, of four digits, and a gap
    ("ipv6", rf"(?<![A-Za-z0-9:.])(?:(?:{_HEX}:){{7}}{_HEX}|[0-9A-Fa-f]{{4}}(?::{_HEX}){{0,6}}::(?:{_HEX}(?::{_HEX}){{0,5}})?)(?![A-Za-z0-9]|:[A-Za-z0-9:]|\.[0-9])"),
    ("date", r"(?<![0-9./-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{4}/[0-9]{2}/[0-9]{2}|[0-9]{2}/[0-9]{2}/[0-9]{4}|[0-9]{2}\.[0-9]{2}\.[0-9]{4})(?![0-9/-]|\.[0-9])"),
    ("written_date", rf"(?<![A-Za-z0-9])(?:[0-9]{{1,2}} {_MONTH} [0-9]{{4}}|{_MONTH} [0-9]{{1,2}}, [0-9]{{4}})(?![A-Za-z0-9])"),
    ("ip", rf"(?<![0-9.])(?<!{_NUMBERED}[.:]?[ ]?)(?:[0-9]{{1,3}}\.){{3}}[0-9]{{1,3}}(?![0-9]|\.[0-9])"),
    ("ssn", r"(?<![A-Za-z0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![A-Za-z0-9-])"),
    ("bare_ssn", rf"(?<![A-Za-z0-9]){_SSN_WORDS}[0-9]{{9}}(?![A-Za-z0-9-])"),
    # in fours and what may follow them; by issuers' other groups; digit by digit; without gaps
    ("card", r"(?<![A-Za-z0-9])(?:[0-9]{4}(?:[ -][0-9]{4}){3,}(?:[ -][0-9]{1,3})?|3[0-9]{3}[ -][0-9]{6}[ -][0-9]{4,5}|[0-9]{6}[ -][0-9]{7,13}|[0-9](?:[ -][0-9]){12,18}|[0-9]{13,19})(?![A-Za-z0-9])"),
    ("phone", r"(?<![A-Za-z0-9+])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![A-Za-z0-9])"),
    ("phone_intl", r"(?<![A-Za-z0-9+])\+[1-9](?:[ .()-]{0,2}[0-9]){7,14}\)?(?![A-Za-z0-9])"),
)
ANY = "|".join(p for _, p in PATTERNS)
#: What every match of ANY has.
_NEEDED = "[0-9@]|" + "|".join(SECRETS)


def _with(value: Column, f) -> Column:
    """``f`` of a value that is computed once, however often ``f`` names it."""
    return F.transform(F.array(value), f)[0]


def _chars(s: Column) -> Column:
    return F.filter(F.split(s, ""), lambda c: c != "")


def _pad(key: Column, r: Column, other: Column, n: int) -> Column:
    """Hex digits from which n numbers of 28 bits can be read."""
    blocks = -(-n * 7 // 64)
    return F.concat(*[F.sha2(F.concat_ws("|", key, r.cast("string"), F.lit(str(b)), other), 256) for b in range(blocks)])


def _number(pad: Column, i: Column) -> Column:
    return F.conv(F.substring(pad, i * 7 + 1, F.lit(7)), 16, 10).cast("long")


def _add(half: Column, classes: Column, other: Column, r: Column, key: Column, longest: int, alphabets: Column) -> Column:
    """``half`` plus the pad, each character within its alphabet; ``classes`` has a letter for each, a key of the map ``alphabets``."""

    def one(c: Column, i: Column, pad: Column) -> Column:
        letters = F.try_element_at(alphabets, F.substring(classes, i + 1, F.lit(1)))
        return _with(letters, lambda al: F.coalesce(F.substring(al, (F.position(c, al) - 1 + _number(pad, i)) % F.length(al) + 1, F.lit(1)), c))

    return F.array_join(F.transform(F.array(_pad(key, r, other, longest)), lambda pad: F.array_join(F.transform(_chars(half), lambda c, i: one(c, i, pad)), "")), "")


def feistel(text: Column, classes: Column, key: Column, longest: int = 32, alphabets: dict[str, str] = ALPHABETS) -> Column:
    """The pseudonym of ``text``; ``classes`` is as long and has a key of ``alphabets`` for each character
    to permute and any other character for one to keep. ``longest`` bounds the length of a half."""
    given = F.struct(text.alias("text"), classes.alias("classes"), F.floor(F.length(text) / 2).cast("int").alias("cut"))
    parts = _with(
        given,
        lambda g: F.struct(
            F.substring(g["text"], F.lit(1), g["cut"]).alias("a"),
            F.substring(g["text"], g["cut"] + 1, F.length(g["text"])).alias("b"),
            F.substring(g["classes"], F.lit(1), g["cut"]).alias("ca"),
            F.substring(g["classes"], g["cut"] + 1, F.length(g["text"])).alias("cb"),
            F.concat_ws("|", key, F.length(g["text"]).cast("string")).alias("tag"),
        ),
    )

    of = F.create_map(*[F.lit(x) for pair in alphabets.items() for x in pair])

    def rounds(p: Column) -> Column:
        def turn(acc: Column, r: Column) -> Column:
            even = r % 2 == 0
            return F.struct(
                F.when(even, _add(acc["a"], p["ca"], acc["b"], r, p["tag"], longest, of)).otherwise(acc["a"]).alias("a"),
                F.when(even, acc["b"]).otherwise(_add(acc["b"], p["cb"], acc["a"], r, p["tag"], longest, of)).alias("b"),
            )

        return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), F.struct(p["a"].alias("a"), p["b"].alias("b")), turn, lambda acc: F.concat(acc["a"], acc["b"]))

    return _with(parts, rounds)


def feistel_number(x: Column, size_a: int, size_b: int, key: Column) -> Column:
    """A keyed permutation of the numbers from 0 to size_a * size_b - 1."""
    start = F.struct(F.floor(x / size_b).cast("long").alias("a"), (x % size_b).cast("long").alias("b"))

    def noise(r: Column, other: Column) -> Column:
        return F.conv(F.substring(F.sha2(F.concat_ws("|", key, r.cast("string"), other.cast("string")), 256), 1, 12), 16, 10).cast("long")

    def turn(acc: Column, r: Column) -> Column:
        even = r % 2 == 0
        return F.struct(
            F.when(even, (acc["a"] + noise(r, acc["b"])) % size_a).otherwise(acc["a"]).alias("a"),
            F.when(even, acc["b"]).otherwise((acc["b"] + noise(r, acc["a"])) % size_b).alias("b"),
        )

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, turn, lambda acc: acc["a"] * size_b + acc["b"])


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def _refill(form: Column, place: str, filling: Column) -> Column:
    """``form`` with its characters that match ``place`` replaced, in order, by those of ``filling``."""
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("used"))

    def filled(f: Column) -> Column:
        def step(acc: Column, c: Column) -> Column:
            hit = c.rlike(place)
            return F.struct(F.concat(acc["out"], F.when(hit, F.substring(f, acc["used"] + 1, F.lit(1))).otherwise(c)).alias("out"), (acc["used"] + hit.cast("int")).alias("used"))

        return F.aggregate(_chars(form), start, step, lambda acc: acc["out"])

    return _with(filling, filled)


def luhn_sum(digits: Column) -> Column:
    """The Luhn sum of a digit string: every second digit from the right is doubled, its digits added."""
    n = F.length(digits)
    value = F.transform(_chars(digits), lambda c, i: F.when((n - i) % 2 == 0, (c.cast("int") * 2) % 10 + F.floor(c.cast("int") / 5).cast("int")).otherwise(c.cast("int")))
    return F.aggregate(value, F.lit(0), lambda a, x: a + x)


def _mod97(chars: Column) -> Column:
    """The remainder by 97 of letters and digits read as a number, with A as 10 to Z as 35."""

    def step(acc: Column, c: Column) -> Column:
        letter = F.ascii(c) - 55
        return F.when(c.rlike("[0-9]"), (acc * 10 + F.ascii(c) - 48) % 97).otherwise((acc * 100 + letter) % 97)

    return F.aggregate(_chars(chars), F.lit(0), step)


def _same(c: str, n: Column) -> Column:
    return F.repeat(F.lit(c), n)


def _class_of_each(s: Column) -> Column:
    """d, l, u or - for each character: digit, small letter, capital, any other."""
    return F.array_join(F.transform(_chars(s), _class_of), "")


def _class_of(c: Column) -> Column:
    return F.when(c.rlike("[0-9]"), "d").when(c.rlike("[a-z]"), "l").when(c.rlike("[A-Z]"), "u").otherwise("-")


def _foreign_class_of(c: Column) -> Column:
    """As ``_class_of``, with the keys of FOREIGN."""
    out = F.lit("-")
    for k, letters in FOREIGN.items():
        out = F.when(F.position(c, F.lit(letters)) > 0, k).otherwise(out)
    return F.when(c < "\x80", _class_of(c)).otherwise(out)


def _pieces(s: Column, key: Column, name: str, class_of=_class_of, alphabets: dict[str, str] = ALPHABETS) -> Column:
    """``s`` permuted in pieces of 64 characters, mostly one."""
    at = F.sequence(F.lit(0), F.floor((F.length(s) - 1) / 64).cast("int"))

    def one(i: Column) -> Column:
        of = lambda x: feistel(x, F.array_join(F.transform(_chars(x), class_of), ""), F.concat_ws("|", key, F.lit(name), i.cast("string")), alphabets=alphabets)
        return _with(F.substring(s, i * 64 + 1, F.lit(64)), of)

    return F.array_join(F.transform(at, one), "")


def _email(m: Column, key: Column) -> Column:
    """Keeps the domain."""
    local, domain = F.substring_index(m, "@", 1), F.substring_index(m, "@", -1)
    return F.concat(_pieces(local, key, "email", _foreign_class_of, ALPHABETS | FOREIGN), F.lit("@"), domain)


def _secret(m: Column, key: Column) -> Column:
    """Keeps the beginning that tells what it is."""
    start = F.regexp_extract(m, f"^(?:{'|'.join(SECRETS)})", 0)
    return F.concat(start, _pieces(F.substring(m, F.length(start) + 1, F.length(m)), F.concat_ws("|", key, start), "secret"))


def _token(m: Column, key: Column) -> Column:
    return feistel(m, F.when(m.rlike("[a-f]"), _same("x", F.length(m))).when(m.rlike("[A-F]"), _same("X", F.length(m))).otherwise(_same("x", F.length(m))), F.concat(key, F.lit("token")))


def _access_key(m: Column, key: Column) -> Column:
    body = F.substring(m, 5, 16)
    return F.concat(F.substring(m, 1, 4), feistel(body, _class_of_each(body), F.concat(key, F.lit("access")), 8))


def _iban(m: Column, key: Column) -> Column:
    plain = F.replace(m, F.lit(" "), F.lit(""))
    country, body = F.substring(plain, 1, 2), F.substring(plain, F.lit(5), F.length(plain))
    new = feistel(body, _class_of_each(body), F.concat(key, F.lit("iban"), country), 15)
    whole = _with(new, lambda x: F.concat(country, F.lpad((98 - _mod97(F.concat(x, country, F.lit("00")))).cast("string"), 2, "0"), x))
    valid = F.length(plain).between(15, 34) & (_mod97(F.concat(body, country, F.substring(plain, 3, 2))) == 1)
    return F.when(valid, _refill(m, "[A-Z0-9]", whole))


def _day(year: Column, month: Column, day: Column) -> Column:
    """Days since FIRST_DAY; null where there is no such date."""
    date = F.try_to_timestamp(F.concat_ws("-", year, month, day), F.lit("yyyy-MM-dd")).cast("date")
    return F.datediff(date, F.lit(FIRST_DAY).cast("date"))


def _moved_day(day: Column, key: Column, written) -> Column:
    """Another day from FIRST_DAY on, as ``written`` puts it; null where the day is outside."""
    new = F.date_add(F.lit(FIRST_DAY).cast("date"), feistel_number(day.cast("long"), DAYS_A, DAYS_B, F.concat(key, F.lit("date"))).cast("int"))
    return F.when(day.between(0, DAYS_A * DAYS_B - 1), _with(new, written))


def _date(m: Column, key: Column) -> Column:
    year_first = m.rlike("^[0-9]{4}")
    sep = F.substring(m, F.when(year_first, 5).otherwise(3), F.lit(1))
    x, y, year = F.substring(m, 1, 2), F.substring(m, 4, 2), F.substring(m, 7, 4)
    dmy = _day(year, y, x)
    day = F.when(year_first, _day(F.substring(m, 1, 4), F.substring(m, 6, 2), F.substring(m, 9, 2))).otherwise(F.coalesce(dmy, _day(year, x, y)))
    months_first = ~year_first & dmy.isNull()

    def written(d: Column) -> Column:
        yyyy, mm, dd = (F.date_format(d, f) for f in ("yyyy", "MM", "dd"))
        return F.when(year_first, F.concat(yyyy, sep, mm, sep, dd)).when(months_first, F.concat(mm, sep, dd, sep, yyyy)).otherwise(F.concat(dd, sep, mm, sep, yyyy))

    return _moved_day(day, key, written)


def _written_date(m: Column, key: Column) -> Column:
    names = F.array(*[F.lit(x) for x in MONTHS])
    name, year = F.regexp_extract(m, "[A-Za-z]+", 0), F.substring(m, F.length(m) - 3, F.lit(4))
    month = F.array_position(F.transform(names, lambda x: F.substring(x, 1, 3)), F.substring(name, 1, 3)).cast("string")
    day = _day(year, F.lpad(month, 2, "0"), F.lpad(F.regexp_extract(m, "(?<![0-9])[0-9]{1,2}(?![0-9])", 0), 2, "0"))

    def written(d: Column) -> Column:
        long = F.element_at(names, F.month(d))
        new = F.when((F.length(name) == 3) & (name != "May"), F.substring(long, 1, 3)).otherwise(long)
        dd, yyyy = F.dayofmonth(d).cast("string"), F.date_format(d, "yyyy")
        return F.when(m.rlike("^[0-9]"), F.concat_ws(" ", dd, new, yyyy)).otherwise(F.concat(new, F.lit(" "), dd, F.lit(", "), yyyy))

    return _moved_day(day, key, written)


def _ip(m: Column, key: Column) -> Column:
    o = [F.split(m, r"\.")[i].cast("long") for i in range(4)]
    n = feistel_number(((o[0] * 256 + o[1]) * 256 + o[2]) * 256 + o[3], 65536, 65536, F.concat(key, F.lit("ip")))
    new = _with(n, lambda x: F.concat_ws(".", *[F.shiftright(x, s).bitwiseAND(255).cast("string") for s in (24, 16, 8, 0)]))
    return F.when((o[0] < 256) & (o[1] < 256) & (o[2] < 256) & (o[3] < 256), new)


def _ipv6(m: Column, key: Column) -> Column:
    """Keeps the first group and permutes the other 112 bits, whatever way they are written; the
    pseudonym has all eight groups."""
    gap = F.position(F.lit("::"), m) > 0
    groups = lambda s: F.transform(F.filter(F.split(s, ":"), lambda g: g != ""), lambda g: F.lpad(F.lower(g), 4, "0"))
    left, right = groups(F.substring_index(m, "::", 1)), F.when(gap, groups(F.substring_index(m, "::", -1))).otherwise(F.array().cast("array<string>"))
    count = F.size(left) + F.size(right)
    bits = F.array_join(F.concat(left, F.array_repeat(F.lit("0000"), F.greatest(F.lit(0), 8 - count)), right), "")

    def written(x: Column) -> Column:
        new = F.concat(F.substring(x, 1, 4), feistel(F.substring(x, 5, 28), _same("x", F.lit(28)), F.concat(key, F.lit("ipv6")), 14))
        return _with(new, lambda y: F.concat_ws(":", *[F.substring(y, 4 * i + 1, 4) for i in range(8)]))

    return F.when(F.when(gap, count < 8).otherwise(count == 8), _with(bits, written))


#: Valid parts of social security numbers: areas 001 to 899 but 666, groups 01 to 99, serials 0001 to 9999.
_AREAS, _GROUPS, _SERIALS = 898, 99, 9999


def _ssn(m: Column, key: Column) -> Column:
    area, group, serial = (F.substring(m, at, n).cast("long") for at, n in ((1, 3), (5, 2), (8, 4)))
    valid = ~m.rlike("^(000|666|9..)-") & ~m.rlike("-00-") & ~m.rlike("-0000$")
    place = ((area - 1 - (area > 666).cast("int")) * _GROUPS + group - 1) * _SERIALS + serial - 1
    new = feistel_number(place, _AREAS * _GROUPS, _SERIALS, F.concat(key, F.lit("ssn")))

    def written(x: Column) -> Column:
        first = F.floor(x / (_GROUPS * _SERIALS)).cast("int")
        parts = ((first + 1 + (first >= 665).cast("int"), 3), (F.floor(x / _SERIALS).cast("int") % _GROUPS + 1, 2), ((x % _SERIALS).cast("int") + 1, 4))
        return F.concat_ws("-", *[F.lpad(p.cast("string"), n, "0") for p, n in parts])

    return F.when(valid, _with(new, written))


def _bare_ssn(m: Column, key: Column) -> Column:
    """The pseudonym of the same number with hyphens, without them."""
    words, d = F.substring(m, F.lit(1), F.length(m) - 9), F.substring(m, F.length(m) - 8, F.lit(9))
    hyphened = F.concat_ws("-", F.substring(d, 1, 3), F.substring(d, 4, 2), F.substring(d, 6, 4))
    return F.concat(words, F.replace(_with(hyphened, lambda x: _ssn(x, key)), F.lit("-"), F.lit("")))


def _card_digits(d: Column, key: Column) -> Column:
    """Keeps the first digit, and makes the check digit anew."""
    n = F.length(d)
    new = F.concat(F.substring(d, 1, 1), feistel(F.substring(d, F.lit(2), n - 2), _same("d", n - 2), F.concat(key, F.lit("card")), 9))
    return _with(new, lambda x: F.concat(x, ((10 - luhn_sum(F.concat(x, F.lit("0"))) % 10) % 10).cast("string")))


def _card(m: Column, key: Column) -> Column:
    """A number in fours may have other numbers in fours, or a short one, beside it: from left to right
    four groups are a card if their check digit is right, or else with three digits after them."""

    def cards(g: Column) -> Column:
        def step(acc: Column, i: Column) -> Column:
            d16, d19 = F.array_join(F.slice(g, i + 1, 4), ""), F.array_join(F.slice(g, i + 1, 5), "")
            of = lambda d, n: F.when((F.length(d) == n) & (luhn_sum(d) % 10 == 0), d)
            found = F.coalesce(of(d16, 16), of(d19, 19))
            moved = _with(
                found,
                lambda d: F.when(
                    d.isNotNull(),
                    F.struct(F.concat(acc["out"], _card_digits(d, key)).alias("out"), (i + F.when(F.length(d) == 16, 4).otherwise(5)).alias("next"), F.lit(True).alias("hit")),
                ).otherwise(F.struct(F.concat(acc["out"], F.element_at(g, i + 1)).alias("out"), (i + 1).alias("next"), acc["hit"].alias("hit"))),
            )
            return F.when(i < acc["next"], acc).otherwise(moved)

        start = F.struct(F.lit("").alias("out"), F.lit(0).alias("next"), F.lit(False).alias("hit"))
        return F.aggregate(F.sequence(F.lit(0), F.size(g) - 1), start, step, lambda acc: F.when(acc["hit"], acc["out"]))

    d = _digits(m)
    n = F.length(d)
    alone = F.when(n.between(13, 19) & (luhn_sum(d) % 10 == 0), _with(d, lambda x: _card_digits(x, key)))
    new = F.when(m.rlike("^(?:[0-9]{4}[ -]){3}"), _with(F.split(m, "[ -]"), cards)).otherwise(alone)
    return _with(new, lambda x: F.when(x.isNotNull(), _refill(m, "[0-9]", x)))


def _phone(m: Column, key: Column) -> Column:
    """Keeps the country code and permutes the ten digits after it; first digits of the area and the
    exchange stay among 2 to 9, or among 0 and 1, where they were."""
    d = _digits(m)
    n = F.length(d)
    code, own = F.substring(d, F.lit(1), n - 10), F.substring(d, n - 9, F.lit(10))
    lead = lambda i: F.when(F.substring(own, i, 1).rlike("[2-9]"), "n").otherwise("o")
    classes = F.concat(lead(1), F.lit("dd"), lead(4), F.lit("dddddd"))
    return _refill(m, "[0-9]", F.concat(code, feistel(own, classes, F.concat(key, F.lit("phone")), 5)))


def _phone_intl(m: Column, key: Column) -> Column:
    """Keeps the country's calling code; the number after it begins with a zero if it did."""
    d = _digits(m)
    code = F.regexp_extract(d, f"^(?:{_CALLING}|[0-9]{{3}})", 0)
    own = F.substring(d, F.length(code) + 1, F.length(d))
    classes = F.concat(F.when(F.substring(own, 1, 1) == "0", "-").otherwise("p"), _same("d", F.length(own) - 1))
    new = F.concat(code, feistel(own, classes, F.concat_ws("|", key, F.lit("intl"), code), 7))
    return F.when(F.length(d).between(8, 15), _refill(m, "[0-9]", new))


_MAKE = {"email": _email, "secret": _secret, "token": _token, "access_key": _access_key, "iban": _iban, "ipv6": _ipv6, "date": _date, "written_date": _written_date, "ip": _ip, "ssn": _ssn, "bare_ssn": _bare_ssn, "card": _card, "phone": _phone, "phone_intl": _phone_intl}


def pseudonym(match: Column, key: Column) -> Column:
    """The pseudonym of one match of ANY; null where it doesn't hold as a value of any kind."""
    # a look-around sees nothing outside the match itself, so anchors suffice here
    return F.coalesce(*[F.when(match.rlike(f"^(?:{pattern})$"), _MAKE[kind](match, key)) for kind, pattern in PATTERNS])


def pseudonymise(docs: DataFrame, key: str, *, text_col: str = "text", count_col: str | None = None) -> DataFrame:
    """``docs`` with the personal data in ``text_col`` replaced; other columns and all rows stay.

    Validated are Luhn sums of card numbers, lengths and remainders of account numbers, octets, calendar
    dates from 1900 to 2099, the area rules of social security numbers and the groups of IPv6 addresses; what
    fails stays as it is, and a valid value beside it is found. Nine digits are a social security number
    only after words that say so, and dotted numbers after "version" and the like are no addresses.
    Null text stays null, text without digits, @ or a secret's beginning stays as it is, and equal texts get equal
    results. ``count_col``, if given, gets the number of values replaced (0 for null text).
    """
    k = F.sha2(F.lit(key), 256)
    text = F.col(text_col)
    (values,) = fresh(docs, "pii_values")
    found = F.when(text.rlike(_NEEDED), F.regexp_extract_all(text, F.lit(ANY), F.lit(0)))
    pairs = F.transform(found, lambda m: F.struct(m.alias("old"), pseudonym(m, k).alias("new")))
    v = F.col(values)
    between = F.split(text, ANY, -1)
    whole = F.array_join(F.zip_with(between, v, lambda t, p: F.concat(t, F.coalesce(p["new"], p["old"], F.lit("")))), "")
    out = docs.withColumn(values, pairs).withColumn(text_col, F.when(F.size(v) > 0, whole).otherwise(text))
    if count_col:
        out = out.withColumn(count_col, F.coalesce(F.size(F.filter(v, lambda p: p["new"].isNotNull())), F.lit(0)))
    return out.drop(values)


KEY = "tidemark-demonstration-key"


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with pseudonyms in their whole texts; null text stays null, rows count one by one."""
    return pseudonymise(table(spark, sf_dir, "documents"), KEY, count_col="n_replaced").select("doc_id", "text", "n_replaced")
