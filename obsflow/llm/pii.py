"""Format-preserving pseudonyms for personal data.

A value that its kind's check confirms (Luhn, mod 97, calendar, octets, number plans) is
read as an integer below the number of valid values of its format, permuted there by a
keyed Feistel network, and written back with the same punctuation.  Equal values get equal
pseudonyms in every document, different ones different pseudonyms, and what the check
rejects stays as it is.

Dates with slashes, or with hyphens and the year last, are read by the number above 12.  If
both are 12 or less, the month comes first unless ``day_first`` is set, once for a corpus.
Days above 12 are permuted among themselves, so that a pseudonym is read like its value.
"""

from __future__ import annotations

import datetime
import hashlib
import ipaddress
import math
import re
from collections.abc import Callable
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 10
_LOW = "abcdefghijklmnopqrstuvwxyz"
_DIGITS = "0123456789"
_HEX = "0123456789abcdef"
# Dates that are permuted among each other.
_FIRST, _LAST = datetime.date(1900, 1, 1).toordinal(), datetime.date(2099, 12, 31).toordinal()

_MAIL = r"(?P<email>[\w+-]+(?:\.[\w+-]+)*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,})|"
_REST = r"""
  (?i:token|secret|password|passwd|api[_-]?key|access[_-]?key|key)["']?\s{0,3}[:=]\s{0,3}["']?(?P<secret>[A-Za-z0-9_+/-]{16,})
 |(?<![\w])(?P<hex>[0-9a-fA-F]{32,})(?![\w])
 |(?<![\w])(?P<iban>[A-Z]{2}\d{2}(?:[ ]?[A-Z0-9]){11,30})(?![\w])
 |(?<![\w.-])(?P<date>\d{4}-\d{1,2}-\d{1,2}|(?<!/)\d{4}/\d{1,2}/\d{1,2}|\d{1,2}\.[ ]?\d{1,2}\.[ ]?\d{4}|\d{1,2}/\d{1,2}/\d{4}|\d{1,2}-\d{1,2}-\d{4})(?:(?=T\d\d:)|(?![\w-]|[./]\d))
 |(?<![\w.-])(?P<written>(?i:\d{1,2}(?:st|nd|rd|th|er|\.)?[ ](?:of[ ]|de[ ])?(?:MONTHS)\.?,?[ ](?:del?[ ])?\d{4}|(?:MONTHS)\.?[ ]\d{1,2}(?:st|nd|rd|th)?,?[ ]\d{4}))(?![\w-]|[./]\d)
 |(?<![\w:.])(?P<ip6>[0-9A-Fa-f]{0,4}(?::[0-9A-Fa-f]{0,4}){2,7})(?![\w:]|\.\d)
 |(?<![\w.])(?P<ip>\d{1,3}(?:\.\d{1,3}){3})(?![\w]|\.\d)
 |(?<![\w-])(?P<ssn>\d{3}-\d{2}-\d{4})(?![\w-])
 |(?<![\w+])(?P<phone>(?:\+|(?<![.,-])00[ ]?)(?:1[ .-]?(?:\([0-9]{3}\)|\d{3})[ .-]?\d{3}[ .-]?\d{4}|[1-9](?:[ ./-]?[(]?\d(?:[)][ .-]?)?){6,14})
   |\(\d{3}\)[ ]?\d{3}[ .-]\d{4}|\d{3}[.-]\d{3}[.-]\d{4}|(?<![.,-])[2-9]\d\d[ ]\d{3}[ -]\d{4}|(?<![.,-])[6-9]\d\d(?:[ ]\d\d){3}
   |(?<![.,-])(?:\(0[1-9]\d{0,4}\)|0[1-9]\d{0,4})(?:[ ]?[ /.-][ ]?\d{2,8}){1,4}|(?<![.,-])0[1-9]\d{8,9})(?![\w-]|\.\d)
 |(?<![\w.-])(?P<card>\d(?:[ -]?\d){12,18})(?![\w-]|\.\d)
"""
# Months as they are written in the languages of the corpus, full names and short ones.
_MONTHS = [(lang, [w.split() for w in (full, short)]) for lang, full, short in (
    ("en", "january february march april may june july august september october november december", "jan feb mar apr may jun jul aug sep oct nov dec"),
    ("en", "january february march april may june july august september october november december", "jan feb mar apr may june july aug sept oct nov dec"),
    ("de", "januar februar märz april mai juni juli august september oktober november dezember", "jan feb mär apr mai jun jul aug sep okt nov dez"),
    ("de", "jänner februar maerz april mai juni juli august september oktober november dezember", "jän feber mrz apr mai jun jul aug sept okt nov dez"),
    ("fr", "janvier février mars avril mai juin juillet août septembre octobre novembre décembre", "janv févr mars avr mai juin juil août sept oct nov déc"),
    ("fr", "janvier fevrier mars avril mai juin juillet aout septembre octobre novembre decembre", "jan fevr mars avr mai juin juill aout sept oct nov dec"),
    ("es", "enero febrero marzo abril mayo junio julio agosto septiembre octubre noviembre diciembre", "ene feb mar abr may jun jul ago sept oct nov dic"),
    ("es", "enero febrero marzo abril mayo junio julio agosto setiembre octubre noviembre diciembre", "ene feb mar abr may jun jul ago sep oct nov dic"))]
_NAMES = sorted({w for _, sets in _MONTHS for ws in sets for w in ws}, key=lambda w: (-len(w), w))
_REST = _REST.replace("MONTHS", "|".join(_NAMES))
_WRITTEN = re.compile(rf"(?P<a>\d{{1,2}})?(?P<th>st|nd|rd|th|er|\.)?(?P<x>[ ]?(?:of[ ]|de[ ])?)(?P<month>{'|'.join(_NAMES)})(?P<y>\.?,?[ ])(?P<b>\d{{1,2}}(?!\d))?(?P<bth>st|nd|rd|th)?(?P<z>.*?)(?P<year>\d{{4}})", re.I)
# Texts without "@" are searched without the slowest alternative.
_FOUND = {True: re.compile(_MAIL + _REST, re.X), False: re.compile(_REST, re.X)}


def permute(value: int, size: int, key: bytes, tweak: bytes) -> int:
    """A keyed permutation of range(size): a Feistel network on two nearly equal parts, walked until it is back in range."""
    if size < 2:
        return value
    a = math.isqrt(size - 1) + 1
    b = -(-size // a)
    wide = (size.bit_length() + 7) // 8

    def part(r: int, x: int, below: int) -> int:
        data = b"%d:%d:%s" % (r, x, tweak)
        h = hashlib.blake2b(data, key=key, digest_size=min(64, wide + 8)).digest()
        return int.from_bytes(h, "big") % below

    while True:
        left, right = divmod(value, b)
        for r in range(0, ROUNDS, 2):
            left = (left + part(r, right, a)) % a
            right = (right + part(r + 1, left, b)) % b
        value = left * b + right
        if value < size:
            return value


def _mixed(places: list[tuple[int, int]], key: bytes, tweak: bytes, valid: Callable[[list[int]], bool] | None = None) -> list[int]:
    """Permute digits given as (digit, radix); walk on until ``valid``."""
    size = math.prod(r for _, r in places)
    x = 0
    for d, r in places:
        x = x * r + d
    while True:
        x = permute(x, size, key, tweak)
        out, y = [], x
        for _, r in reversed(places):
            y, d = divmod(y, r)
            out.append(d)
        out.reverse()
        if valid is None or valid(out):
            return out


def _letters(text: str, key: bytes, tweak: str, keep: int = 0) -> str:
    """Letters for letters and digits for digits, the last ``keep`` characters as they are; capitals as one alphabet with small ones."""
    low = text.lower()
    at = [i for i, c in enumerate(low[:len(low) - keep]) if c in _LOW or c in _DIGITS]
    if len(low) != len(text) or not at:
        return text
    sets = [_LOW if low[i] in _LOW else _DIGITS for i in at]
    shape = "".join("a" if s is _LOW else "9" for s in sets)
    new = _mixed([(s.index(low[i]), len(s)) for i, s in zip(at, sets, strict=True)], key, f"{tweak}:{shape}".encode())
    out = list(text)
    for i, s, d in zip(at, sets, new, strict=True):
        out[i] = s[d].upper() if text[i].isupper() else s[d]
    return "".join(out)


def _digits(text: str, key: bytes, tweak: str, skip: int = 0, valid=None) -> str:
    at = [i for i, c in enumerate(text) if c in _DIGITS][skip:]
    new = _mixed([(int(text[i]), 10) for i in at], key, f"{tweak}:{len(at)}".encode(), valid)
    out = list(text)
    for i, d in zip(at, new, strict=True):
        out[i] = str(d)
    return "".join(out)


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _card(v: str, key: bytes) -> str | None:
    digits = re.sub(r"\D", "", v)
    if not luhn(digits) or len(set(digits)) == 1:
        return None
    body = _digits(digits[:-1], key, "card")
    last = next(c for c in _DIGITS if luhn(body + c))
    new = iter(body + last)
    return "".join(next(new) if c in _DIGITS else c for c in v)


def _iban(v: str, key: bytes) -> str | None:
    number = lambda s: int("".join(str(int(c, 36)) for c in s))
    # Words behind it can look like more of it.
    for end in range(len(v), 14, -1):
        flat = v[:end].replace(" ", "")
        if 15 <= len(flat) <= 34 and number(flat[4:] + flat[:4]) % 97 == 1:
            body = _letters(flat[4:], key, "iban:" + flat[:2])
            new = iter(f"{flat[:2]}{98 - number(body + flat[:2] + '00') % 97:02d}{body}")
            return "".join(c if c == " " else next(new) for c in v[:end])
    return None


def _moved(year: int, month: int, day: int, key: bytes) -> datetime.date | None:
    """The pseudonym of a day; days of the month above 12 stay above 12, the others below."""
    try:
        at = datetime.date(year, month, day).toordinal()
    except ValueError:
        return None
    if not _FIRST <= at <= _LAST:
        return None
    while True:
        at = _FIRST + permute(at - _FIRST, _LAST - _FIRST + 1, key, b"date")
        new = datetime.date.fromordinal(at)
        if (new.day > 12) == (day > 12):
            return new


def _date(v: str, key: bytes, day_first: bool = False) -> str | None:
    a, first, b, second, c = re.fullmatch(r"(\d+)(\D+)(\d+)(\D+)(\d+)", v).groups()
    if len(a) == 4:
        order = (0, 1, 2)
    elif first[0] == "." or int(a) > 12 or day_first and int(b) <= 12:
        order = (2, 1, 0)
    else:
        order = (2, 0, 1)
    parts = [int(x) for x in (a, b, c)]
    new = _moved(*(parts[i] for i in order), key)
    if new is None:
        return None
    width = 1 if min(len(x) for x in (a, b, c)) == 1 else 2
    out = [""] * 3
    for i, x, w in zip(order, (new.year, new.month, new.day), (4, width, width), strict=True):
        out[i] = f"{x:0{w}d}"
    return out[0] + first + out[1] + second + out[2]


def _written(v: str, key: bytes) -> str | None:
    m = _WRITTEN.fullmatch(v)
    if m is None or not (m["a"] or m["b"]):
        return None
    name, before = m["month"].lower(), m["a"] is not None
    # A name of several languages: what is around it tells which.
    first = "de" if m["th"] == "." else "es" if re.search(r"\bdel?\b", m["x"] + m["z"]) else "fr" if m["th"] == "er" else "en"
    likely = [first, "en", *(("fr", "es", "de") if m["month"].islower() else ("de", "fr", "es"))]
    known = [(likely.index(lang), i, form) for i, (lang, forms) in enumerate(_MONTHS) for form in (0, 1) if name in forms[form]]
    _, i, form = min(known)
    names = _MONTHS[i][1][form]
    day = int(m["a"] if before else m["b"])
    new = _moved(int(m["year"]), names.index(name) + 1, day, key)
    if new is None:
        return None
    month = names[new.month - 1]
    month = month.upper() if m["month"].isupper() else month.capitalize() if m["month"][0].isupper() else month

    def ordinal(said: str | None) -> str:
        if not said or said == ".":
            return said or ""
        if said.lower() == "er":
            return "er" if new.day == 1 else ""
        return "th" if new.day in (11, 12, 13) else {1: "st", 2: "nd", 3: "rd"}.get(new.day % 10, "th")

    written = f"{new.day:0{len(m['a'] or m['b']) if (m['a'] or m['b'])[0] == '0' else 1}d}"
    return (written + ordinal(m["th"]) if before else "") + m["x"] + month + m["y"] + ("" if before else written + ordinal(m["bth"])) + m["z"] + str(new.year)


# By number of digits of an octet: the smallest and how many there are.
_OCTETS = {1: (0, 10), 2: (10, 90), 3: (100, 156)}


def _ip(v: str, key: bytes) -> str | None:
    parts = v.split(".")
    if any(int(p) > 255 or len(p) > 1 and p[0] == "0" for p in parts):
        return None
    kinds = [_OCTETS[len(p)] for p in parts]
    new = _mixed([(int(p) - low, n) for p, (low, n) in zip(parts, kinds, strict=True)], key, ("ip:" + ".".join(str(len(p)) for p in parts)).encode())
    return ".".join(str(d + low) for d, (low, _) in zip(new, kinds, strict=True))


def _ip6(v: str, key: bytes) -> str | None:
    """Groups that are not zero are permuted among each other, so any spelling of an address has the same pseudonym."""
    try:
        packed = ipaddress.IPv6Address(v).packed
    except ValueError:
        return None
    groups = [packed[i] * 256 + packed[i + 1] for i in range(0, 16, 2)]
    if not re.search(r"\d", v) or sum(groups) <= 1:
        return None
    at = [i for i, g in enumerate(groups) if g]
    new = _mixed([(groups[i] - 1, 65535) for i in at], key, f"ip6:{at}".encode())
    given = iter(f"{d + 1:x}" for d in new)
    width = 4 if re.search(r"(?<![0-9A-Fa-f])0[0-9A-Fa-f]", v) else 1
    out = re.sub(r"[0-9A-Fa-f]+", lambda m: next(given).zfill(width) if int(m[0], 16) else m[0], v)
    return out.upper() if re.search("[A-F]", v) else out


def _ssn(v: str, key: bytes) -> str | None:
    def valid(d: list[int]) -> bool:
        s = "".join(map(str, d))
        return s[:3] not in ("000", "666") and s[0] != "9" and s[3:5] != "00" and s[5:] != "0000"
    return _digits(v, key, "ssn", valid=valid) if valid([int(c) for c in v if c != "-"]) else None


# Country codes of one and two digits; all others have three.
_CODES = frozenset("1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split())


def _phone(v: str, key: bytes) -> str | None:
    """The country code, or the 0 before an area code, stays; the same number with other separators has the same digits."""
    if "(0)" in v[1:]:
        # Not dialled behind a country code.
        new = _phone(v.replace("(0)", "( )", 1), key)
        return new and new.replace("( )", "(0)", 1)
    digits = "".join(c for c in v if c in _DIGITS)
    away = 2 if digits.startswith("00") and v[0] == "0" else 0
    n = len(digits) - away
    if not 7 <= n <= 15:
        return None
    if away or v[0] == "+":
        code = next((digits[away:away + k] for k in (1, 2) if digits[away:away + k] in _CODES), digits[away:away + 3])
        return _digits(v, key, f"phone:{code}", skip=away + len(code))
    if digits[0] == "0":
        # The digit behind is not 0, or the pseudonym would be read as a number with a country code.
        return _digits(v, key, "phone:0", skip=1, valid=lambda d: d[0] != 0) if digits[1] != "0" and n >= 9 else None
    return _digits(v, key, "phone:")


def _hex(v: str, key: bytes) -> str:
    new = _mixed([(_HEX.index(c), 16) for c in v.lower()], key, b"hex:%d" % len(v))
    out = "".join(_HEX[d] for d in new)
    return out.upper() if v.upper() == v and v.lower() != v else out


def _secret(v: str, key: bytes) -> str | None:
    if re.fullmatch(r"[0-9a-fA-F]+", v):
        return _hex(v, key)
    return _letters(v, key, "secret") if re.search(r"\d", v) else None


def _email(v: str, key: bytes) -> str:
    return _letters(v, key, "email", keep=len(v) - v.rindex("."))


KINDS: dict[str, Callable[[str, bytes], str | None]] = {
    "email": _email, "secret": _secret, "hex": _hex, "iban": _iban, "date": _date, "written": _written, "ip6": _ip6, "ip": _ip, "ssn": _ssn, "phone": _phone, "card": _card}
_ANY = re.compile("[0-9@]")


@lru_cache(maxsize=16)
def _whole(key: bytes) -> bytes:
    """All of a key of any length, as 32 bytes."""
    return hashlib.blake2b(key, digest_size=32, person=b"obsflow.key").digest()


def pseudonymise(text: str, key: bytes, day_first: bool = False) -> tuple[str, list[tuple[str, str]]]:
    """The text with its values replaced, and the pseudonyms as (kind, pseudonym)."""
    found: list[tuple[str, str]] = []
    if not _ANY.search(text):
        return text, found
    key = _whole(key)
    search = _FOUND["@" in text].search
    out, done, at = [], 0, 0
    while m := search(text, at):
        kind = m.lastgroup
        start = m.start(kind)
        new = _date(m[kind], key, day_first) if kind == "date" else KINDS[kind](m[kind], key)
        if new is None:
            at = start + 1
            continue
        found.append(("date" if kind == "written" else kind, new))
        out += [text[done:start], new]
        # An IBAN can end before what was found; a day or a month can have more digits than before.
        done = at = start + len(new) if kind == "iban" else m.end(kind)
    return "".join([*out, text[done:]]), found


def pseudonyms(text: Column, key: str, day_first: bool = False) -> Column:
    """struct<text, values array<struct<kind, pseudonym>>> of a text column; a null text stays null."""
    raw = key.encode()

    @F.pandas_udf("text string, values array<struct<kind:string,pseudonym:string>>")
    def run(s: pd.Series) -> pd.DataFrame:
        got = [(None, []) if t is None else pseudonymise(t, raw, day_first) for t in s]
        return pd.DataFrame({"text": [g[0] for g in got], "values": [[{"kind": k, "pseudonym": p} for k, p in g[1]] for g in got]})

    return run(text)


def pseudonymised(docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text", day_first: bool = False) -> DataFrame:
    """``doc_id, text, n_values, values`` of every row: the text with pseudonyms, how many, and which.

    Null texts stay null, empty ones empty, both without values.  Other columns are ignored.
    """
    return (docs.select(F.col(id_col).cast("bigint").alias("doc_id"), pseudonyms(F.col(text_col).cast("string"), key, day_first).alias("p"))
            .select("doc_id", "p.text", F.size("p.values").cast("bigint").alias("n_values"), F.col("p.values").alias("values")))


def linked_values(done: DataFrame) -> DataFrame:
    """``kind, pseudonym, n_docs, first_doc`` of every value in the output of ``pseudonymised``."""
    v = done.select("doc_id", F.explode("values").alias("v")).select("doc_id", "v.kind", "v.pseudonym").distinct()
    return v.groupBy("kind", "pseudonym").agg(F.count("*").alias("n_docs"), F.min("doc_id").alias("first_doc"))
