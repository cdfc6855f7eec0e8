"""Format-preserving Feistel pseudonyms for personal data, in DataFrame functions only.

Found values that pass their check are replaced by a keyed permutation within their own format, so
equal values get equal pseudonyms in every document and a reader of the key can undo them:

* e-mail addresses: the part before the @, of 1 to 64 characters; the domain, which has a dot
  between two of its names, stays;
* card numbers of 13 to 19 digits (Luhn): all digits but the last, which is computed anew;
* IBANs (mod 97): the account part, with new check digits;
* telephone numbers (7 to 15 digits; + and the country code stay);
* US social security numbers, IPv4 addresses and calendar dates from 1900 to 2099: their index
  among all valid values.

Strings go through a Feistel network over their characters: one half is shifted, digit by digit
and letter by letter, by an HMAC of the other half; signs stay in place. Indexes go through
the same network over the two digits of a mixed-radix number whose radices multiply to the number
of valid values, so the image is valid without cycle walking.

Cards and IBANs are checked before the text is cut: at every place the length of an IBAN of its
country and the fixed forms of cards (4-4-4-4 and up to 3 more, 4-6-5, 4-6-4, one run of digits)
are tried besides the longest match, so a code or currency that follows does not hide them.

Defined results: a null text stays null with 0 finds; a text without finds is returned as it is;
values that fail their check (13 digits without a Luhn sum, 30 February, 300.1.1.1) stay. No
shuffle takes place; repeated rows and ids do not matter; other columns are passed through; an
empty table gives an empty result. Time grows with the length of a text and the number of its
distinct cards and IBANs; no text is too long.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.shared import fresh

ROUNDS = 8

#: No pattern repeats a group without bound: Java's matcher recurses for each turn of one, and a
#: long text would exhaust the stack. The domain is one class here and checked afterwards.
EMAIL = r"(?<![\p{L}\p{N}._%+-])[A-Za-z0-9_%+-][A-Za-z0-9._%+-]{0,63}+@[A-Za-z0-9-][A-Za-z0-9.-]*+"
DOMAIN = r"^[A-Za-z0-9-]+\.[A-Za-z0-9-]"
EDGE, END = r"(?<![\p{L}\p{N}_])(?<!\p{N}[./-])", r"(?![\p{L}\p{N}_])(?![./-]\p{N})"
IPV4 = r"\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}"
DATE = r"\d{4}-\d{1,2}-\d{1,2}|\d{4}/\d{1,2}/\d{1,2}|\d{1,2}/\d{1,2}/\d{4}|\d{1,2}\.\d{1,2}\.\d{4}"
SSN = r"\d{3}-\d{2}-\d{4}"
IBAN = r"[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?"
CARD = r"\d(?:[ -]?\d){12,18}"
PHONE = r"\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,5}(?:[ .-]?\d{2,5}){1,4}|\(\d{3}\) ?\d{3}[.-]\d{4}|\d{3}[ .-]\d{3}[ .-]\d{4}"
#: Besides the longest match: the forms in which card numbers are written.
CARDS = (r"\d{4}[ -]\d{4}[ -]\d{4}[ -]\d{4}[ -]\d{1,3}", r"\d{4}[ -]\d{4}[ -]\d{4}[ -]\d{4}", r"\d{4}[ -]\d{6}[ -]\d{5}", r"\d{4}[ -]\d{6}[ -]\d{4}", r"\d{13,19}")
#: Countries by the length of their IBANs.
IBAN_LENGTHS = {15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU"}
IBAN_OF = "|".join(rf"(?:{c.replace(' ', '|')})\d{{2}}(?: ?[A-Z0-9]){{{n - 4}}}" for n, c in IBAN_LENGTHS.items())
#: An address may have a port, a prefix or the end of a range behind it, a date its time.
FIRST = rf"{EMAIL}|(?<![\p{{L}}\p{{N}}_])(?<!\p{{N}}\.){IPV4}(?![\p{{L}}\p{{N}}_])(?!\.\p{{N}})|{EDGE}(?:{DATE})(?:{END}|(?=[Tt]\d{{2}}))|{EDGE}{SSN}{END}"
LAST = f"{EDGE}(?:{PHONE}){END}"
#: 1900-01-01 to 2099-12-31 is 73,049 = 17 x 4,297 days.
DAYS = (17, 4297)
FIRST_DAY = "1900-01-01"
AREAS = 898  # 001 to 899 without 666


def _digest(key: str, tweak: str, *parts: Column) -> Column:
    """HMAC-SHA-256, in hex, of the parts under a key made from ``key`` and ``tweak``. The key
    itself appears in no plan."""
    own = hashlib.sha256(f"{tweak}|{key}".encode()).digest().ljust(64, b"\0")
    pad = lambda by: F.lit(bytes(b ^ by for b in own))
    inner = F.sha2(F.concat(pad(0x36), F.concat_ws("|", *[p.cast("string") for p in parts]).cast("binary")), 256)
    return F.sha2(F.concat(pad(0x5C), F.unhex(inner)), 256)


def _once(value: Column, f) -> Column:
    """f(value), with the value computed once however often f uses it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _number(hex_digest: Column) -> Column:
    return F.conv(F.substring(hex_digest, 1, 12), 16, 10).cast("long")


def _chars(s: Column) -> Column:
    return F.filter(F.split(s, ""), lambda c: c != "")


def _shifted(c: Column, by: Column, back: bool) -> Column:
    """The character moved by ``by`` places within its class; others stay."""
    step = -by if back else by
    code = F.ascii(c)
    move = lambda first, n: F.char((F.pmod(code - first + step, F.lit(n)) + first).cast("int"))
    return F.when(c.between("0", "9"), move(48, 10)).when(c.between("a", "z"), move(97, 26)).when(c.between("A", "Z"), move(65, 26)).otherwise(c)


def permute_string(s: Column, key: str, tweak: str, back: bool = False) -> Column:
    """Keyed permutation of the strings that have the digits, letters and signs of ``s`` in the
    same places. ``back`` undoes it."""

    def mixed(half: Column, other: Column, r: Column) -> Column:
        place = lambda d, i: F.conv(F.substring(d, (i % 32) * 2 + 1, 2), 16, 10).cast("int")
        return _once(_digest(key, tweak, r, F.length(half), other), lambda d: F.array_join(F.transform(_chars(half), lambda c, i: _shifted(c, place(d, i), back)), ""))

    middle = (F.length(s) / 2).cast("int")
    start = F.struct(F.substring(s, F.lit(1), middle).alias("l"), F.substring(s, middle + 1, F.length(s)).alias("r"))
    rounds = F.array(*[F.lit(i) for i in (range(ROUNDS - 1, -1, -1) if back else range(ROUNDS))])
    turn = lambda a, i: F.when(i % 2 == 0, F.struct(mixed(a["l"], a["r"], i).alias("l"), a["r"].alias("r"))).otherwise(F.struct(a["l"].alias("l"), mixed(a["r"], a["l"], i).alias("r")))
    return F.aggregate(rounds, start, turn, lambda a: F.concat(a["l"], a["r"]))


def permute_index(i: Column, a: int, b: int, key: str, tweak: str, back: bool = False) -> Column:
    """Keyed permutation of 0 to a * b - 1. ``back`` undoes it."""
    sign = -1 if back else 1
    start = F.struct(F.floor(i / F.lit(b)).cast("long").alias("l"), F.pmod(i, F.lit(b)).cast("long").alias("r"))
    rounds = F.array(*[F.lit(k) for k in (range(ROUNDS - 1, -1, -1) if back else range(ROUNDS))])

    def turn(s: Column, k: Column) -> Column:
        left = F.pmod(s["l"] + sign * _number(_digest(key, tweak, k, s["r"])), F.lit(a)).cast("long")
        right = F.pmod(s["r"] + sign * _number(_digest(key, tweak, k, s["l"])), F.lit(b)).cast("long")
        return F.when(k % 2 == 0, F.struct(left.alias("l"), s["r"].alias("r"))).otherwise(F.struct(s["l"].alias("l"), right.alias("r")))

    return F.aggregate(rounds, start, turn, lambda s: s["l"] * b + s["r"])


def digits_of(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def _fill(template: Column, digits: Column) -> Column:
    """The template with its digits replaced, in order."""
    return _placed(template, digits, lambda c: c.between("0", "9"))


def _placed(template: Column, values: Column, where) -> Column:
    """The template with the characters that ``where`` chooses replaced by those of ``values``."""
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("n"))

    def fill(new: Column) -> Column:
        turn = lambda a, c: F.when(where(c), F.struct(F.concat(a["out"], F.substring(new, a["n"] + 1, F.lit(1))).alias("out"), (a["n"] + 1).alias("n"))).otherwise(F.struct(F.concat(a["out"], c).alias("out"), a["n"].alias("n")))
        return F.aggregate(_chars(template), start, turn, lambda a: a["out"])

    return _once(values, fill)


def luhn_sum(digits: Column) -> Column:
    """Luhn sum modulo 10; 0 for a valid number."""
    turned = _chars(F.reverse(digits))
    add = lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise((c.cast("int") * 2 / 10).cast("int") + (c.cast("int") * 2) % 10)
    return F.aggregate(F.transform(turned, add), F.lit(0), lambda a, x: a + x) % 10


def mod97(account: Column) -> Column:
    """Remainder by 97 of a string of digits and capital letters, A being 10."""
    turn = lambda a, c: F.when(c.between("0", "9"), (a * 10 + (F.ascii(c) - 48)) % 97).otherwise((a * 100 + (F.ascii(c) - 55)) % 97)
    return F.aggregate(_chars(account), F.lit(0), turn)


def _card(m: Column, key: str) -> Column:
    def image(d: Column) -> Column:
        check = lambda body: F.pmod(10 - luhn_sum(F.concat(body, F.lit("0"))), F.lit(10)).cast("int").cast("string")
        new = _once(permute_string(F.substring(d, F.lit(1), F.length(d) - 1), key, "card"), lambda body: F.concat(body, check(body)))
        return F.when(luhn_sum(d) == 0, _fill(m, new))

    return _once(digits_of(m), image)


def _iban_holds(m: Column) -> Column:
    flat = F.regexp_replace(m, " ", "")
    return (mod97(F.concat(F.substring(flat, F.lit(5), F.length(flat)), F.substring(flat, 1, 4))) == 1) & F.length(flat).between(15, 34)


def _iban(m: Column, key: str) -> Column:
    flat = F.regexp_replace(m, " ", "")
    country, account = F.substring(flat, 1, 2), F.substring(flat, F.lit(5), F.length(flat))
    check = lambda image: F.lpad((98 - mod97(F.concat(image, country, F.lit("00")))).cast("string"), 2, "0")
    new = _once(permute_string(account, key, "iban"), lambda image: F.concat(country, check(image), image))
    return F.when(_iban_holds(m), _placed(m, new, lambda c: c != " "))


def _phone(m: Column, key: str) -> Column:
    head = F.regexp_extract(m, r"^(\+\d{1,3})(?:[ .(-]|$)", 1)
    head = F.when((head == "") & m.startswith("+"), F.substring(m, 1, 3)).otherwise(head)
    tail = F.substring(m, F.length(head) + 1, F.length(m))
    return F.when(F.length(digits_of(m)).between(7, 15), F.concat(head, permute_string(tail, key, "phone")))


def _ssn(m: Column, key: str) -> Column:
    part = lambda at, n: F.substring(m, at, n).cast("int")
    area, group, serial = part(1, 3), part(5, 2), part(8, 4)
    valid = area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)
    i = ((area - F.when(area < 666, 1).otherwise(2)).cast("long") * 99 + group - 1) * 9999 + serial - 1

    def written(j: Column) -> Column:
        a = F.floor(j / (99 * 9999)).cast("int")
        return F.format_string("%03d-%02d-%04d", (a + F.when(a < 665, 1).otherwise(2)).cast("int"), (F.floor(j / 9999) % 99 + 1).cast("int"), (j % 9999 + 1).cast("int"))

    return F.when(valid, _once(permute_index(i, AREAS * 99, 9999, key, "ssn"), written))


def _ipv4(m: Column, key: str) -> Column:
    octets = F.transform(F.split(m, r"\."), lambda x: x.cast("long"))
    number = F.aggregate(octets, F.lit(0).cast("long"), lambda a, x: a * 256 + x)
    octet = lambda j, k: (F.floor(j / (256**k)) % 256).cast("string")
    return F.when(F.forall(octets, lambda x: x <= 255), _once(permute_index(number, 65536, 65536, key, "ipv4"), lambda j: F.concat_ws(".", octet(j, 3), octet(j, 2), octet(j, 1), octet(j, 0))))


def _date(m: Column, key: str) -> Column:
    sep = F.regexp_extract(m, r"([-/.])", 1)
    p = F.transform(F.split(m, "[-/.]"), lambda x: x)
    one, two, three = F.element_at(p, 1), F.element_at(p, 2), F.element_at(p, 3)
    year_first = F.length(one) == 4
    dated = lambda y, mo, d: F.try_to_date(F.concat_ws("-", y, F.lpad(mo, 2, "0"), F.lpad(d, 2, "0")), "yyyy-MM-dd")
    ymd, dmy, mdy = dated(one, two, three), dated(three, two, one), dated(three, one, two)
    day = F.when(year_first, ymd).otherwise(F.coalesce(dmy, mdy))
    i = F.datediff(day, F.lit(FIRST_DAY).cast("date"))

    def written(new: Column) -> Column:
        part = lambda f, like: F.when(F.length(like) == 2, F.lpad(f(new).cast("string"), 2, "0")).otherwise(f(new).cast("string"))
        joined = lambda x, y, z: F.concat(x, sep, y, sep, z)
        year = F.lpad(F.year(new).cast("string"), 4, "0")
        return F.when(year_first, joined(year, part(F.month, two), part(F.dayofmonth, three))).when(dmy.isNotNull(), joined(part(F.dayofmonth, one), part(F.month, two), year)).otherwise(joined(part(F.month, one), part(F.dayofmonth, two), year))

    moved = F.date_add(F.lit(FIRST_DAY).cast("date"), permute_index(i, *DAYS, key, "date").cast("int"))
    return F.when(i.between(0, DAYS[0] * DAYS[1] - 1), _once(moved, written))


def _email(m: Column, key: str) -> Column:
    local = F.substring_index(m, "@", 1)
    rest = F.substring(m, F.length(local) + 1, F.length(m))
    return F.when(F.substring(rest, F.lit(2), F.length(rest)).rlike(DOMAIN), F.concat(permute_string(local, key, "email"), rest))


def pseudonym(m: Column, key: str) -> Column:
    """The pseudonym of a found value, or null if it fails its check."""
    is_ = lambda pattern: m.rlike(f"^(?:{pattern})$")
    return F.when(m.contains("@"), _email(m, key)).when(is_(IPV4), _ipv4(m, key)).when(is_(DATE), _date(m, key)).when(is_(SSN), _ssn(m, key)).when(is_("[A-Z].*"), _iban(m, key)).otherwise(F.coalesce(F.when(is_(CARD), _card(m, key)), F.when(is_(PHONE), _phone(m, key))))


def checked_numbers(text: Column) -> Column:
    """Card numbers and IBANs in a text that pass their check, those to be preferred first."""
    each = lambda form: F.regexp_extract_all(text, F.lit(f"(?={EDGE}({form}){END})"), 1)
    longest = lambda form: F.regexp_extract_all(text, F.lit(f"{EDGE}(?:{form}){END}"), 0)
    none = F.array().cast("array<string>")
    ibans = F.filter(F.array_distinct(F.concat(each(IBAN_OF), longest(IBAN))), _iban_holds)
    cards = F.filter(F.array_distinct(F.concat(longest(CARD), *[each(c) for c in CARDS])), lambda c: luhn_sum(digits_of(c)) == 0)
    return F.concat(F.when(text.rlike(r"[A-Z]{2}\d{2} ?[A-Z0-9]"), ibans).otherwise(none), F.when(text.rlike(r"\d(?:[ -]?\d){12}"), cards).otherwise(none))


def pseudonymise(docs: DataFrame, key: str, text_col: str = "text", count_col: str = "n_found") -> DataFrame:
    """``docs`` with personal data in ``text_col`` replaced and the number of replaced values; a
    column called as the count is replaced."""
    text, numbers, old, new = F.col(text_col), fresh(docs, "numbers"), fresh(docs, "found"), fresh(docs, "pseudonyms")
    found = docs.drop(count_col).withColumn(numbers, F.when(text.rlike("[0-9@]"), checked_numbers(text)))
    own = F.concat(F.lit(f"{FIRST}|{EDGE}(?:"), F.array_join(numbers, "|"), F.lit(f"){END}|{LAST}"))
    by_own = lambda f: F.when(F.size(numbers) > 0, f(own)).otherwise(f(F.lit(f"{FIRST}|{LAST}")))
    found = found.withColumn(old, F.when(F.col(numbers).isNotNull(), by_own(lambda pattern: F.regexp_extract_all(text, pattern, F.lit(0)))))
    found = found.withColumn(new, F.when(F.size(old) > 0, F.transform(old, lambda m: pseudonym(m, key))))
    gaps = by_own(lambda pattern: F.split(text, pattern, -1))
    fills = F.zip_with(new, old, lambda n, m: F.coalesce(n, m))
    joined = F.array_join(F.zip_with(gaps, fills, lambda g, f: F.concat(g, F.coalesce(f, F.lit("")))), "")
    hits = F.size(F.filter(new, lambda n: n.isNotNull()))
    return found.withColumn(text_col, F.when(F.col(new).isNotNull(), joined).otherwise(text)).withColumn(count_col, F.when(F.col(new).isNull(), 0).otherwise(hits).cast("int")).drop(numbers, old, new)
