"""Format-preserving pseudonyms for personal data, in native expressions.

Validated numbers and dates (payment cards, bank accounts, social security and phone
numbers, IP addresses, calendar dates), e-mail addresses and quoted secrets are replaced
by keyed permutations of themselves inside their own format, by Feistel networks
whose round function is SHA-256 over the key.  A permutation is a function of
the value and the key alone: equal values get equal pseudonyms in every document, also
where they are written differently (a date's notation, a number's spacing, a mail
address's case); different values of one kind and format never collide, and no table of
pseudonyms is kept or shuffled.  The work is one pass over the text with no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prefmine.llm.common import free_name

ROUNDS = 10

# Lengths of bank account numbers (IBAN registry).
IBAN_LENGTHS = {land: n for n, lands in {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK ST TN VG", 25: "LY PT",
    26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA",
    30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU"}.items() for land in lands.split()}


def _iban_pattern() -> str:
    """Groups of four to the country's length; for other countries any fitting length."""
    by_length: dict[int, list[str]] = {}
    for land, n in IBAN_LENGTHS.items():
        by_length.setdefault(n, []).append(land)
    fixed = [rf"(?:{'|'.join(lands)})\d{{2}}(?: ?[A-Z0-9]{{4}}){{{(n - 4) // 4}}}" + (f" ?[A-Z0-9]{{{n % 4}}}" if n % 4 else "")
             for n, lands in by_length.items()]
    other = rf"(?!{'|'.join(IBAN_LENGTHS)})[A-Z]{{2}}\d{{2}}(?: ?[A-Z0-9]{{4}}){{2,7}}(?: ?[A-Z0-9]{{1,3}})?"
    return rf"(?<![A-Za-z0-9])(?=[A-Z]{{2}}\d{{2}})(?:{'|'.join([*fixed, other])})(?![A-Za-z0-9])"


# What is found (Java regular expressions), tried in this order at each place.  A
# secret is found with its closing quote, in which no other find ends: that tells it
# from numbers of the same shape.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}+@[A-Za-z0-9](?:[A-Za-z0-9-]{0,62}\.){1,8}[A-Za-z]{2,24}(?![A-Za-z0-9])",
    "secret": r"(?<=[\"'])(?<=(?i:token|secret|passwd|password|api_key|api-key|apikey)[\"']? ?[=:] ?[\"'])[^\"'\s]++[\"']",
    "ipv4": r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(?!\.?\d)",
    "ipv6": r"(?<![0-9A-Za-z:.])(?=[0-9A-Fa-f:]*\d)(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6}"
            r"|(?:[0-9A-Fa-f]{1,4}:){1,7}:(?![0-9A-Fa-f:])|::(?:[0-9A-Fa-f]{1,4}:){0,6}[0-9A-Fa-f]{1,4})(?![0-9A-Za-z:])",
    "date": r"(?<![\d./-])(?:\d{4}-\d{2}-\d{2}|\d{4}/\d{2}/\d{2}|\d{2}/\d{2}/\d{4}|\d{2}\.\d{2}\.\d{4}|\d{2}-\d{2}-\d{4})(?![./-]?\d)",
    "phone": r"(?<![\d+])\+1[ .-]?(?:\(\d{3}\)|\d{3})[ .-]?\d{3}[ .-]?\d{4}(?!\d)"
             r"|(?<![\d+])\+[2-9]\d{0,2}[ -]?(?:\(\d{1,4}\)[ -]?)?\d{2,4}(?:[ -]?\d{2,4}){1,3}(?!\d)"
             r"|(?<![\d(])\(\d{3}\) ?\d{3}-\d{4}(?!\d)|(?<![\d.-])\d{3}(?<sepa>[.-])\d{3}\k<sepa>\d{4}(?![.-]?\d)"
             r"|(?<![\d+(.,/-])0\d{1,4}[ -]\d{3,4}[ -]?\d{3,4}(?![\d-])",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])|(?<=(?i:ssn|social security number)(?i: no\.?)?[ :#=]{1,3})\d{9}(?!\d)",
    "iban": _iban_pattern(),
    "card": r"(?<!\d)(?:\d{4}(?<sepb>[ -])\d{4}\k<sepb>\d{4}\k<sepb>\d{4}|\d{4}(?<sepc>[ -])\d{6}\k<sepc>\d{5}|\d{13,19})(?!\d)",
}
FOUND = "|".join(f"(?:{p})" for p in PATTERNS.values())
_SECRET = "[\"']$"
# Every find has a digit, an at sign or a secret's name before it; texts without any are not searched.
CHEAP = "[0-9@]|(?i:token|secret|passw|api.?key)"
# Country codes of telephone numbers (ITU E.164): 1 and 7, the two-digit ones, else three digits; or a trunk zero.
PHONE_CODE = r"^(?:\+(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3})|0)"

# Halves of a permuted text over this many characters stand as their digest in the rounds.
LONG_HALF = 256

# The 400 years from 1700 on: 4800 months with 57,600 days up to the twelfth (240 * 240)
# and 88,497 later ones (9 * 9833).
FIRST_DAY, MONTHS = "1700-01-01", 4800
EARLY, LATE = (240, 240), (9, 9833)
# Valid social security numbers: 898 areas (001-899 but 666), 99 groups, 9999 serials.
SSN_A, SSN_B = 898 * 99, 9999


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _prf(key: str, kind: str, *parts: Column) -> Column:
    """60 keyed pseudo-random bits as a long."""
    text = F.concat_ws("|", F.lit(key), F.lit(kind), *[p.cast("string") for p in parts], F.lit(key))
    return F.conv(F.substring(F.sha2(text, 256), 1, 15), 16, 10).cast("long")


def permute(x: Column, a: int, b: int, key: str, kind: str) -> Column:
    """A keyed permutation of [0, a*b): an unbalanced Feistel network over the
    two digits (x // b, x % b); each round adds a keyed function of one to the other."""
    start = F.struct((F.floor(x / F.lit(b))).cast("long").alias("l"), (x % F.lit(b)).cast("long").alias("r"))

    def step(s: Column, i: Column) -> Column:
        left = F.pmod(s.l + F.pmod(_prf(key, kind, i, F.lit("l"), s.r), F.lit(a)), F.lit(a))
        return _let(F.struct(left.cast("long").alias("l"), s.r.alias("r")), lambda t: F.struct(
            t.l.alias("l"), F.pmod(t.r + F.pmod(_prf(key, kind, i, F.lit("r"), t.l), F.lit(b)), F.lit(b)).cast("long").alias("r")))

    rounds = F.sequence(F.lit(1), F.lit(ROUNDS // 2))
    return F.aggregate(rounds, start, step, lambda s: s.l * F.lit(b) + s.r)


_CLASSES = ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")


def _shift_char(c: Column, by: Column) -> Column:
    """The character ``by`` places on in its class (digit, lower, upper); others stay."""
    out = c
    for chars in _CLASSES:
        n = len(chars)
        at = F.instr(F.lit(chars), c) - 1
        out = F.when(c.isin(*chars), F.substr(F.lit(chars), (F.pmod(at + F.pmod(by, F.lit(n)), F.lit(n)) + 1).cast("int"),
                                              F.lit(1))).otherwise(out)
    return out


def permute_text(s: Column, key: str, kind: str) -> Column:
    """A keyed permutation of the strings of one shape: digits stay digits, lower
    and upper case letters stay such, all else stays as it is.  A Feistel network
    over the two halves; each round shifts every character of one half inside its
    class by a keyed function of the other half (of its digest, if it is long: the
    work is linear in the length)."""
    half = (F.length(s) / 2).cast("int")
    start = F.struct(F.substr(s, F.lit(1), half).alias("l"), F.substr(s, half + 1, F.length(s)).alias("r"))

    def shifted(moving: Column, fixed: Column, i: Column, side: str) -> Column:
        chars = F.filter(F.split(moving, ""), lambda c: c != "")
        told = F.when(F.length(fixed) > LONG_HALF, F.sha2(fixed, 256)).otherwise(fixed)
        return _let(told, lambda f: F.array_join(F.transform(chars, lambda c, j: _shift_char(
            c, _prf(key, kind, i, F.lit(side), j, f))), ""))

    def step(st: Column, i: Column) -> Column:
        return _let(F.struct(shifted(st.l, st.r, i, "l").alias("l"), st.r.alias("r")), lambda t: F.struct(
            t.l.alias("l"), shifted(t.r, t.l, i, "r").alias("r")))

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS // 2)), start, step, lambda t: F.concat(t.l, t.r))


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, r"\D", "")


def _refill(shape: Column, digits: Column) -> Column:
    """``shape`` with its digits replaced by ``digits`` in order."""
    chars = F.filter(F.split(shape, ""), lambda c: c != "")
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("at"))
    return F.aggregate(chars, start, lambda a, c: F.when(
        c.rlike("^[0-9]$"), F.struct(F.concat(a.out, F.substr(digits, a["at"], F.lit(1))).alias("out"), (a["at"] + 1).alias("at"))
    ).otherwise(F.struct(F.concat(a.out, c).alias("out"), a["at"].alias("at"))), lambda a: a.out)


def luhn_sum(digits: Column) -> Column:
    """Luhn sum of a digit string whose last digit is the check digit's place."""
    chars = F.filter(F.split(F.reverse(digits), ""), lambda c: c != "")
    values = F.transform(chars, lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(
        F.floor(c.cast("int") * 2 / 10).cast("int") + (c.cast("int") * 2) % 10))
    return F.aggregate(values, F.lit(0), lambda a, v: a + v)


def is_card(s: Column) -> Column:
    """Issuer ranges of payment cards (3 to 6, 2221 to 2720) and the Luhn check."""
    return s.rlike(r"^(?:[3-6]|2[2-7])[\d -]+$") & (luhn_sum(_digits(s)) % 10 == 0)


def card(s: Column, key: str) -> Column:
    """Inside Luhn-valid numbers of the same length and issuer digit."""
    def fill(d: Column) -> Column:
        body = F.concat(F.substr(d, F.lit(1), F.lit(2)),
                        permute_text(F.substr(d, F.lit(3), F.length(d) - 3), key, "card"))
        return _let(body, lambda b: F.concat(b, ((10 - luhn_sum(F.concat(b, F.lit("0"))) % 10) % 10).cast("string")))
    return _refill(s, _let(_digits(s), fill))


def ipv4(s: Column, key: str) -> Column:
    parts = F.split(s, r"\.")
    octet = lambda i: F.element_at(parts, i).cast("long")
    x = octet(1) * 16777216 + octet(2) * 65536 + octet(3) * 256 + octet(4)
    return _let(permute(x, 65536, 65536, key, "ipv4"), lambda y: F.concat_ws(".", *[
        (F.shiftright(y, k) % 256).cast("string") for k in (24, 16, 8, 0)]))


def _day(s: Column, fmt: str) -> Column:
    return F.try_to_timestamp(s, F.lit(fmt)).cast("date")


# shape of a date -> the readings tried in turn
_DATES = ((r"^\d{4}-", ("yyyy-MM-dd",)), (r"^\d{4}/", ("yyyy/MM/dd",)), (r"^\d{2}\.", ("dd.MM.yyyy",)),
          (r"^\d{2}/", ("dd/MM/yyyy", "MM/dd/yyyy")), (r"^\d{2}-", ("dd-MM-yyyy", "MM-dd-yyyy")))


def _late_before(month: Column) -> Column:
    """Days after a twelfth before the ``month``-th month from 1700 on."""
    first = F.lit(FIRST_DAY).cast("date")
    return F.datediff(F.add_months(first, month.cast("int")), first).cast("long") - 12 * month


def moved_day(day: Column, key: str) -> Column:
    """A keyed permutation of the days of 1700 to 2099; days up to the twelfth and later ones are
    each permuted among themselves.  So a day and month that can be read either way become such
    ones again, those that can be read one way become such ones, and no two dates of
    one notation meet."""
    first = F.lit(FIRST_DAY).cast("date")
    month = ((F.year(day) - 1700) * 12 + F.month(day) - 1).cast("long")

    def early(y: Column) -> Column:
        return F.date_add(F.add_months(first, F.floor(y / F.lit(12)).cast("int")), (y % 12).cast("int"))

    def late(y: Column) -> Column:
        # A month has 18.4 such days on average and never runs ahead or behind by more than one month.
        about = F.floor(y / F.lit(LATE[0] * LATE[1] / MONTHS)).cast("long")
        near = F.filter(F.sequence(about - 3, about + 3), lambda m: (m >= 0) & (m < MONTHS) & (_late_before(m) <= y))
        return _let(F.array_max(near), lambda m: F.date_add(F.add_months(first, m.cast("int")), (12 + y - _late_before(m)).cast("int")))

    rank = F.datediff(day, first).cast("long") - 12 * (month + 1)
    return F.when(F.dayofmonth(day) <= 12, _let(permute(month * 12 + F.dayofmonth(day) - 1, *EARLY, key, "date"), early)).otherwise(
        _let(permute(rank, *LATE, key, "late date"), late))


def date(s: Column, key: str) -> Column:
    """Inside the 400 years from 1700 on, in the same notation; null if ``s`` is no
    calendar day of these.  Equal days are equal in all notations."""
    def moved(fmt: str) -> Column:
        return _let(_day(s, fmt), lambda d: F.when(F.year(d).between(1700, 2099), F.date_format(moved_day(d, key), fmt)))

    out = F.lit(None).cast("string")
    for shape, formats in _DATES:
        out = F.when(s.rlike(shape), F.coalesce(*[moved(f) for f in formats])).otherwise(out)
    return out


def is_ssn(s: Column) -> Column:
    return s.rlike(r"^(?!000|666|9)\d{3}-(?!00)\d{2}-(?!0000)\d{4}$")


def plain_ssn(s: Column, key: str) -> Column:
    """Nine digits without hyphens, linked with the hyphened form; null if not valid."""
    cut = F.concat_ws("-", F.substr(s, F.lit(1), F.lit(3)), F.substr(s, F.lit(4), F.lit(2)), F.substr(s, F.lit(6), F.lit(4)))
    return _let(cut, lambda c: F.when(is_ssn(c), F.replace(ssn(c, key), F.lit("-"), F.lit(""))))


def ssn(s: Column, key: str) -> Column:
    """Inside the valid area, group and serial numbers."""
    area, group, serial = (F.element_at(F.split(s, "-"), i).cast("long") for i in (1, 2, 3))
    x = ((area - F.when(area > 666, 2).otherwise(1)) * 99 + group - 1) * SSN_B + serial - 1

    def fill(y: Column) -> Column:
        ag, se = F.floor(y / F.lit(SSN_B)).cast("long"), y % SSN_B
        a = F.floor(ag / F.lit(99)).cast("long") + 1
        a = F.when(a >= 666, a + 1).otherwise(a)
        return F.concat_ws("-", F.lpad(a.cast("string"), 3, "0"), F.lpad((ag % 99 + 1).cast("string"), 2, "0"),
                           F.lpad((se + 1).cast("string"), 4, "0"))
    return _let(permute(x, SSN_A, SSN_B, key, "ssn"), fill)


def mod97(s: Column) -> Column:
    """The ISO 7064 remainder of a string of digits and upper-case letters (A = 10)."""
    chars = F.filter(F.split(s, ""), lambda c: c != "")
    value = lambda c: F.when(c.rlike("^[0-9]$"), c.cast("int")).otherwise(F.instr(F.lit(_CLASSES[2]), c) + 9)
    return F.aggregate(chars, F.lit(0), lambda a, c: ((a * F.when(c.rlike("^[0-9]$"), 10).otherwise(100) + value(c)) % 97).cast("int"))


def is_iban(s: Column) -> Column:
    plain = F.replace(s, F.lit(" "), F.lit(""))
    lengths = F.create_map(*[F.lit(x) for pair in IBAN_LENGTHS.items() for x in pair])
    n = F.try_element_at(lengths, F.substr(plain, F.lit(1), F.lit(2)))
    return F.coalesce(F.length(plain) == n, F.length(plain).between(12, 34)) & (mod97(F.concat(F.substr(plain, F.lit(5), F.length(plain)), F.substr(plain, F.lit(1), F.lit(4)))) == 1)


def iban(s: Column, key: str) -> Column:
    """Inside the valid account numbers of the same country and shape."""
    def fill(plain: Column) -> Column:
        land = F.substr(plain, F.lit(1), F.lit(2))
        body = permute_text(F.substr(plain, F.lit(5), F.length(plain)), key, "iban")
        return _let(body, lambda b: F.concat(
            land, F.lpad((98 - mod97(F.concat(b, land, F.lit("00")))).cast("string"), 2, "0"), b))

    made = _let(F.replace(s, F.lit(" "), F.lit("")), fill)
    # The spaces stay where they are.
    chars = F.filter(F.split(s, ""), lambda c: c != "")
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("at"))
    return _let(made, lambda m: F.aggregate(chars, start, lambda a, c: F.when(
        c == " ", F.struct(F.concat(a.out, c).alias("out"), a["at"].alias("at"))).otherwise(
        F.struct(F.concat(a.out, F.substr(m, a["at"], F.lit(1))).alias("out"), (a["at"] + 1).alias("at"))), lambda a: a.out))


def iban_and_tail(s: Column, key: str) -> Column:
    """The longest valid account number that ``s`` begins with, up to a space or the
    end, replaced; what follows stays.  Null if there is none."""
    groups = F.split(s, " ")
    starts = F.transform(F.sequence(F.size(groups), F.lit(1), F.lit(-1)), lambda k: F.array_join(F.slice(groups, F.lit(1), k), " "))
    return _let(F.get(F.filter(starts, is_iban), F.lit(0)), lambda v:
                F.concat(iban(v, key), F.substr(s, F.length(v) + 1, F.length(s))))


def phone(s: Column, key: str) -> Column:
    """All digits but the country code or trunk zero, in place; however the digits are
    grouped, equal numbers stay equal."""
    code = F.regexp_extract(s, PHONE_CODE, 0)
    rest = F.substr(s, F.length(code) + 1, F.length(s))
    return F.concat(code, _refill(rest, permute_text(_digits(rest), key, "phone")))


def email(s: Column, key: str) -> Column:
    """Local part and domain keep their shape, the top-level domain stays; the permutation is
    one of lower-case addresses, capitals stay where they are."""
    chars = lambda c: F.filter(F.split(c, ""), lambda x: x != "")
    name = F.regexp_extract(s, r"^(.*)\.[A-Za-z]+$", 1)
    moved = permute_text(F.translate(name, _CLASSES[2], _CLASSES[1]), key, "email")
    shaped = F.zip_with(chars(name), chars(moved), lambda a, b: F.when(a.rlike("^[A-Z]$"), F.translate(b, _CLASSES[1], _CLASSES[2])).otherwise(b))
    return F.concat(F.array_join(shaped, ""), F.regexp_extract(s, r"\.[A-Za-z]+$", 0))


def ipv6(s: Column, key: str) -> Column:
    """The address in full (eight groups of four digits, lower case), so that all spellings
    of one address stay linked; null if it has too many groups."""
    sides = F.split(s, "::", -1)
    groups = lambda i: F.filter(F.split(F.coalesce(F.get(sides, F.lit(i)), F.lit("")), ":"), lambda g: g != "")
    n = F.size(groups(0)) + F.size(groups(1))
    valid = F.when(F.size(sides) == 1, n == 8).otherwise(n <= 7)
    full = F.array_join(F.transform(F.concat(groups(0), F.array_repeat(F.lit("0"), F.greatest(8 - n, F.lit(0))), groups(1)),
                                    lambda g: F.lpad(F.lower(g), 4, "0")), "")

    def fill(whole: Column) -> Column:
        part = lambda at: F.conv(F.substr(whole, F.lit(at), F.lit(16)), 16, -10).cast("long")
        start = F.struct(part(1).alias("l"), part(17).alias("r"))

        def step(st: Column, i: Column) -> Column:
            told = F.sha2(F.concat_ws("|", F.lit(key), F.lit("ipv6"), i.cast("string"), st.r.cast("string"), F.lit(key)), 256)
            return F.struct(st.r.alias("l"), st.l.bitwiseXOR(F.conv(F.substring(told, 1, 16), 16, -10).cast("long")).alias("r"))

        text = lambda c: F.lower(F.lpad(F.hex(c), 16, "0"))
        hexed = F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, step, lambda t: F.concat(text(t.l), text(t.r)))
        return _let(hexed, lambda h: F.concat_ws(":", *[F.substr(h, F.lit(4 * k + 1), F.lit(4)) for k in range(8)]))

    return F.when(valid, _let(full, fill))


def pseudonym(s: Column, key: str) -> Column:
    """The pseudonym of one found string (a secret with its closing quote); null if it is not
    valid."""
    bare = F.substr(s, F.lit(1), F.length(s) - 1)
    return (F.when(s.rlike(_SECRET), F.concat(permute_text(bare, key, "secret"), F.right(s, F.lit(1))))
            .when(s.contains("@"), email(s, key))
            .when(s.contains(":"), ipv6(s, key))
            .when(s.rlike(r"^\d{1,3}(\.\d{1,3}){3}$"), ipv4(s, key))
            .when(s.rlike(r"^(\d{4}[-/]\d{2}[-/]\d{2}|\d{2}[-/.]\d{2}[-/.]\d{4})$"), date(s, key))
            .when(s.rlike(r"^\d{3}-\d{2}-\d{4}$"), F.when(is_ssn(s), ssn(s, key)))
            .when(s.rlike(r"^\d{9}$"), plain_ssn(s, key))
            .when(s.rlike(r"^[+(]|^\d{3}[.-]\d{3}[.-]\d{4}$|^0\d{1,4}[ -]\d{3,4}[ -]?\d{3,4}$"), phone(s, key))
            .when(s.rlike(r"^[A-Z]{2}"), iban_and_tail(s, key))
            .otherwise(F.when(is_card(s), card(s, key))))


def pseudonymise(docs: DataFrame, key: str, text: str = "text", count: str | None = None) -> DataFrame:
    """``docs`` with every find in ``text`` replaced by its pseudonym under ``key``; ``count``
    names a column (replaced, if there is one) for the number of strings replaced.

    Numbers that fail their check (a card number's Luhn sum, an impossible day)
    stay as they are and are not counted, and so does all other text: columns, order and
    number of rows do not change, lengths only where an IP address is written in more
    or fewer digits.  Null stays null, an empty text empty; repeated
    rows get equal results.  A text of any length is searched whole, in one expression of its row.  No other
    column is added, so no name can clash.
    """
    t = F.col(text)
    parts = F.split(t, FOUND, -1)

    # parts[0] + pseudonym(found[0]) + parts[1] + ...
    def joined(found: Column, names: Column) -> Column:
        shown = F.zip_with(names, found, lambda p, s: F.coalesce(p, s))
        return F.when(F.size(found) > 0, F.array_join(F.zip_with(parts, shown, lambda p, s: F.concat(p, F.coalesce(s, F.lit("")))), "")).otherwise(t)

    named = lambda found: F.transform(found, lambda s: pseudonym(s, key))
    if count is None:
        swapped = _let(_found(t), lambda found: joined(found, named(found)))
        return docs.withColumn(text, F.when(t.rlike(CHEAP), swapped).otherwise(t))
    both = _let(_found(t), lambda found: _let(named(found), lambda names: F.struct(
        joined(found, names).alias("text"), F.size(F.filter(names, lambda p: p.isNotNull())).cast("long").alias("n"))))
    done = free_name(docs.columns, "done_")
    whole = docs.withColumn(done, F.when(t.rlike(CHEAP), both).otherwise(F.struct(t.alias("text"), F.lit(0).cast("long").alias("n"))))
    cols = [F.col(f"{done}.text").alias(c) if c == text else F.col(c) for c in docs.columns if c != count]
    return whole.select(*cols, F.col(f"{done}.n").alias(count))


def _found(t: Column) -> Column:
    return F.regexp_extract_all(t, F.lit(f"({FOUND})"), 1)


def finds(text: str = "text") -> Column:
    """Array of the strings that the patterns find in the text, before validation."""
    t = F.col(text)
    bare = F.transform(_found(t), lambda s: F.regexp_replace(s, _SECRET, ""))
    return F.when(t.rlike(CHEAP), bare).otherwise(F.array().cast("array<string>"))
