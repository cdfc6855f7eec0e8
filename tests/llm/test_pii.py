"""Pseudonyms against a plain Python version, and texts made to exhaust a pattern matcher."""

from __future__ import annotations

import hashlib
import hmac
import time
from datetime import date, timedelta

import regex

from tessera.llm import pii

KEY = "k"


def luhn(d):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def digest(tweak, *parts):
    own = hashlib.sha256(f"{tweak}|{KEY}".encode()).digest()
    return hmac.new(own, "|".join(map(str, parts)).encode(), "sha256").hexdigest()


def string(s, tweak):
    left, right = s[: len(s) // 2], s[len(s) // 2 :]
    for r in range(pii.ROUNDS):
        half, other = (left, right) if r % 2 == 0 else (right, left)
        d = digest(tweak, r, len(half), other)
        out = ""
        for i, c in enumerate(half):
            by = int(d[i % 32 * 2 : i % 32 * 2 + 2], 16)
            for first, n in (("0", 10), ("a", 26), ("A", 26)):
                if 0 <= ord(c) - ord(first) < n:
                    c = chr(ord(first) + (ord(c) - ord(first) + by) % n)
                    break
            out += c
        left, right = (out, right) if r % 2 == 0 else (left, out)
    return left + right


def index(i, a, b, tweak):
    left, right = divmod(i, b)
    for k in range(pii.ROUNDS):
        if k % 2 == 0:
            left = (left + int(digest(tweak, k, right)[:12], 16)) % a
        else:
            right = (right + int(digest(tweak, k, left)[:12], 16)) % b
    return left * b + right


def fill(template, new, kept=str.isalnum):
    new = iter(new)
    return "".join(next(new) if kept(c) else c for c in template)


def mod97(s):
    return int("".join(str(int(c, 36)) for c in s)) % 97


def calendar(y, m, d):
    try:
        return date(int(y), int(m), int(d))
    except ValueError:
        return None


def dated(m):
    sep = regex.search("[-/.]", m)[0]
    one, two, three = m.split(sep)
    order = "ymd" if len(one) == 4 else "dmy"
    day = calendar(one, two, three) if order == "ymd" else calendar(three, two, one)
    if day is None and order == "dmy":
        order, day = "mdy", calendar(three, one, two)
    if day is None or not 1900 <= day.year <= 2099:
        return None
    new = date(1900, 1, 1) + timedelta(index((day - date(1900, 1, 1)).days, *pii.DAYS, "date"))
    part = {"y": lambda like: f"{new.year:04}", "m": lambda like: f"{new.month:0{len(like)}}", "d": lambda like: f"{new.day:0{len(like)}}"}
    return sep.join(part[o](like) for o, like in zip(order, (one, two, three), strict=True))


def pseudonym(m):
    whole = lambda p: regex.fullmatch(p, m, regex.ASCII)
    if "@" in m:
        local, domain = m.split("@", 1)
        return string(local, "email") + "@" + domain if regex.match(pii.DOMAIN, domain) else None
    if whole(pii.IPV4):
        octets = [int(x) for x in m.split(".")]
        if max(octets) > 255:
            return None
        j = index(int.from_bytes(bytes(octets)), 65536, 65536, "ipv4")
        return ".".join(map(str, j.to_bytes(4)))
    if whole(pii.DATE):
        return dated(m)
    if whole(pii.SSN):
        area, group, serial = (int(x) for x in m.split("-"))
        if not (1 <= area <= 899 and area != 666 and group and serial):
            return None
        areas = [a for a in range(1, 900) if a != 666]
        j = index((areas.index(area) * 99 + group - 1) * 9999 + serial - 1, 898 * 99, 9999, "ssn")
        return f"{areas[j // (99 * 9999)]:03}-{j // 9999 % 99 + 1:02}-{j % 9999 + 1:04}"
    if m[0].isupper():
        flat = m.replace(" ", "")
        if not (15 <= len(flat) <= 34 and mod97(flat[4:] + flat[:4]) == 1):
            return None
        account = string(flat[4:], "iban")
        return fill(m, f"{flat[:2]}{98 - mod97(account + flat[:2] + '00'):02}{account}")
    digits = "".join(c for c in m if c.isdigit())
    if whole(pii.CARD) and luhn(digits):
        body = string(digits[:-1], "card")
        return fill(m, body + next(c for c in "0123456789" if luhn(body + c)), str.isdigit)
    if whole(pii.PHONE) and 7 <= len(digits) <= 15:
        head = regex.match(r"(\+\d{1,3})(?:[ .(-]|$)", m)
        head = head[1] if head else m[:3] if m[0] == "+" else ""
        return head + string(m[len(head) :], "phone")
    return None


def replaced(text):
    if text is None or not regex.search("[0-9@]", text):
        return text, 0
    every = lambda form: [m[1] for m in regex.finditer(f"(?={pii.EDGE}({form}){pii.END})", text)]
    longest = lambda form: regex.findall(f"{pii.EDGE}(?:{form}){pii.END}", text)
    flat = lambda x: x.replace(" ", "")
    own = [x for x in dict.fromkeys([*every(pii.IBAN_OF), *longest(pii.IBAN)]) if 15 <= len(flat(x)) <= 34 and mod97(flat(x)[4:] + flat(x)[:4]) == 1]
    own += [x for x in dict.fromkeys([*longest(pii.CARD), *(y for c in pii.CARDS for y in every(c))]) if luhn("".join(c for c in x if c.isdigit()))]
    n, out, at = 0, [], 0
    for m in regex.finditer(f"{pii.FIRST}|{pii.EDGE}(?:{'|'.join(own)}){pii.END}|{pii.LAST}" if own else f"{pii.FIRST}|{pii.LAST}", text):
        new = pseudonym(m[0])
        n += new is not None
        out += [text[at : m.start()], m[0] if new is None else new]
        at = m.end()
    return "".join([*out, text[at:]]), n


def test_documents_come_out_as_by_plain_python(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    more = ["jo@a.b", "a@b..com x", "a@b.com. End", "x" * 65 + "@a.org " + "y" * 64 + "@a.org", "1/2/2001 31.12.1999 2000/2/29 2001-02-29", "899-01-0001 666-01-0001", "GB82 WEST 1234 5698 7654 32 EUR", "(415) 555-2671 and 415-555-2671", "378282246310005 or 3782 822463 10005", "255.0.0.1 256.0.0.1 1.2.3"]
    docs = docs.unionByName(spark.createDataFrame([(-1 - i, x) for i, x in enumerate(more)], "doc_id long, text string"))
    want = {r.doc_id: replaced(r.text) for r in docs.collect()}
    got = {r.doc_id: (r.text, r.n_found) for r in pii.pseudonymise(docs, KEY).collect()}
    assert got == want
    assert sum(n for _, n in want.values()) > 20


def test_no_text_stops_a_task(spark):
    mb = 1 << 20
    cards = [f"4{i:014}" for i in range(3_000)]
    cards = [c + next(d for d in "0123456789" if luhn(c + d)) for c in cards]
    texts = ["a@b" + ".c" * (mb // 2), "a" * mb + "@b.org", "a@" + "b" * mb, "a@b.c" * (mb // 5), "1" * mb, "1 " * (mb // 2), "1-" * (mb // 2), "+1 1 " * (mb // 5), "+1 11 11" * (mb // 8), "(" * mb, "2000-01-0" * (mb // 9), "DE00 " * (mb // 5), "DE00 0000 0000 " * (mb // 15), "1.1.1." * (mb // 6), "4111 1111 1111 1111 " * (mb // 80), " ".join(cards) * 3]
    start = time.monotonic()
    out = {r.id: r for r in pii.pseudonymise(spark.createDataFrame(list(enumerate(texts)), "id long, text string"), KEY).collect()}
    assert time.monotonic() - start < 120
    assert out[0].n_found == 1 and out[0].text.endswith("@b" + ".c" * (mb // 2)) and out[1].n_found == 0
    assert all(len(out[i].text) == len(x) for i, x in enumerate(texts) if i not in (13,))
    assert pii.pseudonymise(spark.createDataFrame([], "id long, text string"), KEY).count() == 0
