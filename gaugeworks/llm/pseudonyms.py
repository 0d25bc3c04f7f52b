"""Format-preserving pseudonyms for personal data, by keyed Feistel permutations.

Each value found is validated, turned into a number within its format's domain, permuted
there by a Feistel network under a key of its format, and written back in the same form. As
a permutation maps equal values alike, and different ones differently, values stay linked
across documents while none is shown.
"""

from __future__ import annotations

import datetime
import hashlib
import math
import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from gaugeworks.llm.common import column, map_arrow
from gaugeworks.llm.groups import pa_types

ROUNDS = 8
#: One pattern; the first alternative that fits at a place names the kind.
_FOUND = re.compile(
    r"(?P<email>(?<![\w.%+-])[\w%+][\w.%+-]*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+)"
    r"|(?P<ipv4>(?<![\w.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?!\w|\.[0-9]))"
    r"|(?P<date>(?<![\w.-])(?:[0-9]{4}[-/.][0-9]{2}[-/.][0-9]{2}|[0-9]{2}[-/.][0-9]{2}[-/.][0-9]{4})(?![\w-]|[./][0-9]))"
    r"|(?P<iban>(?<!\w)[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w))"
    r"|(?P<ssn>(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-]))"
    # international: country code and an area in parentheses; then groups of digits
    r"|(?P<phone>(?<![\w+])\+[0-9]{1,3}[ .-]?\([0-9]{1,5}\)[ ./-]?[0-9]{1,8}(?:[ ./-][0-9]{1,8}){0,5}(?!\w)"
    r"|(?<![\w+])\+[0-9]{1,3}(?:[ /-][0-9]{1,12}(?:[ ./-][0-9]{1,8}){0,6}|(?:\.[0-9]{1,8}){2,6}(?:-[0-9]{1,8})?|\.(?:[0-9]{2,5}|[0-9]{9,12}))(?!\w|[.-][0-9])"
    r"|(?<![\w+])\+[0-9]{7,15}(?!\w)"
    r"|(?<![\w+.,/-])00[1-9][0-9]{0,2}[ ./-]\(?[0-9]{1,8}\)?(?:[ ./-][0-9]{1,8}){1,6}(?!\w|[.-][0-9])"
    # national: (ddd) ddd-dddd and the like, behind 1 or not; groups behind a leading 0
    r"|(?:(?<![\w+.,/-])1[ .-]?|(?<![\w(]))\([0-9]{3}\)[ ./-]?[0-9]{3}[-. ]?[0-9]{4}(?!\w)"
    r"|(?<![\w+.,/-])(?:1[ ./-])?[0-9]{3}(?:[./-][0-9]{3}[ .-]|(?<=[2-9][0-9]{2})[ ][2-9][0-9]{2}[ .-])[0-9]{4}(?!\w|[.-][0-9])"
    r"|(?<![\w+.,/-])(?:0[1-9][0-9]{0,4}|\(0[1-9][0-9]{0,4}\))[ ./-][0-9]{1,8}(?:[ ./-][0-9]{1,8}){0,5}(?!\w|[.-][0-9]))"
    r"|(?P<card>(?<![\w-])(?:[0-9]{13,19}|[0-9]{4}(?:[ -][0-9]{4}){2,3}(?:[ -]?[0-9]{1,3})?|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5})(?![\w-]))"
    r"|(?P<secret>(?<!\w)(?:[0-9a-f]{32,128}|[0-9A-F]{32,128})(?!\w))"
)
#: Digits of a whole number behind these country codes, and of a national number with its leading 0.
_PHONE_SIZES = {"1": 11, "7": 11, "33": 11, "34": 11, "44": 12}
LEADING_0 = (9, 12)
#: Lengths of IBANs by country, as registered; others are tried at every length.
_IBAN_SIZES = {
    c[:2]: int(c[2:])
    for c in (
        "AD24 AE23 AL28 AT20 AZ28 BA20 BE16 BG22 BH22 BI27 BR29 BY28 CH21 CR22 CY28 CZ24 DE22 DJ27 DK18 DO28 EE20 EG29 ES24 FI18 FK18 FO18 FR27 GB22 GE22 GI23 GL18 "
        "GR27 GT28 HR21 HU28 IE22 IL23 IQ23 IS26 IT27 JO30 KW30 KZ20 LB28 LC32 LI21 LT20 LU20 LV21 LY25 MC27 MD24 ME22 MK19 MN20 MR27 MT31 MU30 NI28 NL18 NO15 OM23 "
        "PK24 PL28 PS29 PT25 QA29 RO24 RS22 RU33 SA24 SC31 SD18 SE24 SI19 SK24 SM27 SO23 ST25 SV28 TL23 TN24 TR26 UA29 VA22 VG24 XK20"
    ).split()
}
_BORDER = re.compile(r"[ ./-]")
#: Every kind holds one of these; what they stand in is searched, up to white space.
_HINT = re.compile(r"[0-9@]+")
#: Characters that one value may have between its hints.
_BRIDGE = 12
_DIGITS = re.compile(r"[0-9]")
_DDD = re.compile(r"\(?[0-9]{3}(?:\)[ ./-]?|[ ./-])[0-9]{3}[ .-]?[0-9]{4}")
#: The date domain, both ends within.
FIRST_DAY, LAST_DAY = datetime.date(1900, 1, 1), datetime.date(2099, 12, 31)


@lru_cache(maxsize=4096)
def _round_key(key: bytes, domain: int, turn: int) -> bytes:
    return hashlib.blake2b(b"%d:%d" % (domain, turn), key=key, digest_size=16).digest()


def _feistel(value: int, key: bytes, domain: int, back: bool) -> int:
    """A permutation of range(domain): an unbalanced Feistel network on range(a * b), a * b
    being the next product at or above the domain, walked until it ends within."""
    a = max(2, math.isqrt(domain - 1) + 1)
    while True:
        left, right = divmod(value, a)
        for turn in reversed(range(ROUNDS)) if back else range(ROUNDS):
            to = _round_key(key, domain, turn)
            if back:
                left, right = (right - _mask(left, to, a)) % a, left
            else:
                left, right = right, (left + _mask(right, to, a)) % a
        value = left * a + right
        if value < domain:
            return value


def _mask(half: int, key: bytes, size: int) -> int:
    data = half.to_bytes((half.bit_length() + 7) // 8 or 1, "big")
    if size < 1 << 128:
        return int.from_bytes(hashlib.blake2b(data, key=key, digest_size=24).digest(), "big") % size
    # 64 bits more than the size has, so that no residue is favoured
    return int.from_bytes(hashlib.shake_256(key + data).digest(size.bit_length() // 8 + 9), "big") % size


def permute(value: int, key: bytes, kind: str, domain: int, back: bool = False) -> int:
    """``value`` of range(domain) under the kind's own key; ``back`` undoes it."""
    return _feistel(value, _kind_key(key, kind), domain, back) if domain > 1 else value


@lru_cache(maxsize=4096)
def _kind_key(key: bytes, kind: str) -> bytes:
    return hashlib.blake2b(kind.encode(), key=key, digest_size=32).digest()


def luhn(digits: str) -> int:
    """The check digit that follows ``digits``."""
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (2 if k % 2 == 0 else 1)
        total += n - 9 if n > 9 else n
    return -total % 10


def _refill(form: str, digits: str) -> str:
    """``form`` with its digits replaced in order."""
    it = iter(digits)
    return _DIGITS.sub(lambda m: next(it), form)


def _date(text: str) -> tuple[datetime.date, str] | None:
    """The day and the form it is written in: year first, else day first, else month first."""
    if not text[4].isdigit():
        forms = [f"%Y{text[4]}%m{text[7]}%d"] if text[4] == text[7] else []
    else:
        forms = [f"%d{text[2]}%m{text[5]}%Y", f"%m{text[2]}%d{text[5]}%Y"] if text[2] == text[5] else []
    for form in forms:
        try:
            day = datetime.datetime.strptime(text, form).date()
        except ValueError:
            continue
        if FIRST_DAY <= day <= LAST_DAY:
            return day, form
    return None


@lru_cache(maxsize=1 << 17)
def _other_day(day: datetime.date, key: bytes, month_first: bool, back: bool) -> datetime.date:
    """The day that stands for ``day``, in every form the same. What is read month first has
    a day above 12, or it would be read day first; there the permutation goes on until it
    comes to such a day again, so the forms' images are as distinct as the forms."""
    while True:
        n = permute((day - FIRST_DAY).days, key, "date", (LAST_DAY - FIRST_DAY).days + 1, back)
        day = FIRST_DAY + datetime.timedelta(n)
        if not month_first or day.day > 12:
            return day


#: Alphabets within which a character of a name is replaced.
_ALPHABETS = (
    "0123456789",
    "abcdefghijklmnopqrstuvwxyz",
    "ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "ßàáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿ",
    "ÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÐÑÒÓÔÕÖØÙÚÛÜÝÞ",
)
_PLACE = {c: (n, k) for n, letters in enumerate(_ALPHABETS) for k, c in enumerate(letters)}


def _characters(text: str, key: bytes, kind: str, back: bool) -> str:
    """Each digit and letter becomes one of its alphabet, the rest stays: the whole is one
    number in a mixed radix and is permuted as such."""
    value, domain, shape = 0, 1, []
    for c in text:
        n, k = _PLACE.get(c, (None, 0))
        shape.append(n)
        if n is not None:
            value, domain = value * len(_ALPHABETS[n]) + k, domain * len(_ALPHABETS[n])
    value = permute(value, key, f"{kind}:{''.join('-' if n is None else str(n) for n in shape)}", domain, back)
    out = []
    for c, n in zip(reversed(text), reversed(shape)):
        if n is not None:
            value, k = divmod(value, len(_ALPHABETS[n]))
            c = _ALPHABETS[n][k]
        out.append(c)
    return "".join(reversed(out))


def pseudonym(kind: str, text: str, key: bytes, back: bool = False) -> str | None:
    """What stands for ``text``, or None where it isn't valid as ``kind``."""
    if kind == "email":
        local, _, host = text.partition("@")
        name, dot, top = host.rpartition(".")
        return f"{_characters(local, key, 'local', back)}@{_characters(name, key, 'host', back)}{dot}{top}"
    digits = "".join(_DIGITS.findall(text))
    if kind == "ipv4":
        parts = text.split(".")
        if any(int(p) > 255 or (len(p) > 1 and p[0] == "0") for p in parts):
            return None
        value = int.from_bytes(bytes(map(int, parts)), "big")
        return ".".join(map(str, permute(value, key, kind, 1 << 32, back).to_bytes(4, "big")))
    if kind == "date":
        found = _date(text)
        if not found:
            return None
        day, form = found
        return _other_day(day, key, form.startswith("%m"), back).strftime(form)
    if kind == "iban":
        plain = text.replace(" ", "")
        number = lambda s: int("".join(str(int(c, 36)) for c in s))
        if not 15 <= len(plain) <= 34 or number(plain[4:] + plain[:4]) % 97 != 1:
            return None
        body = _characters(plain[4:], key, kind, back)
        check = 98 - number(body + plain[:2] + "00") % 97
        it = iter(f"{plain[:2]}{check:02d}{body}")
        return "".join(c if c == " " else next(it) for c in text)
    if kind == "card":
        # all but the check digit is permuted, which follows from the others
        body = digits[:-1]
        if luhn(body) != int(digits[-1]):
            return None
        body = str(permute(int(body), key, f"card{len(digits)}", 10 ** len(body), back)).zfill(len(body))
        return _refill(text, f"{body}{luhn(body)}")
    if kind == "secret":
        value = permute(int(text, 16), key, f"hex{len(text)}", 16 ** len(text), back)
        out = f"{value:0{len(text)}x}"
        return out.upper() if text.upper() == text else out
    if kind == "phone":
        trunk = not text.startswith("+") and digits[0] == "0" and digits[1] != "0" and not _DDD.fullmatch(text)
        low, high = LEADING_0 if trunk else (7, 15)
        if not low <= len(digits) - 2 * text.startswith("00") <= high:
            return None
        # the country code stays, and what is dialled before a national number
        country = re.match(r"\+\d{1,3}(?=[ ./(-])|\+\d|00\d{1,3}(?=[ ./(-])", text)
        keep = len(_DIGITS.findall(country[0])) if country else int(trunk or len(digits) == 11 and text[0] == "1")
        rest = digits[keep:]
        return _refill(text, digits[:keep] + str(permute(int(rest), key, f"phone{len(rest)}", 10 ** len(rest), back)).zfill(len(rest)))
    return _ssn(text, digits, key, back)


def _ssn(text: str, digits: str, key: bytes, back: bool) -> str | None:
    """Areas 000, 666 and 900 to 999, group 00 and serial 0000 are never given out."""
    area, group, serial = int(digits[:3]), int(digits[3:5]), int(digits[5:])
    if area in (0, 666) or area > 899 or not group or not serial:
        return None
    place = area - 1 - (area > 666)
    value = permute((place * 99 + group - 1) * 9999 + serial - 1, key, "ssn", 898 * 99 * 9999, back)
    place, group, serial = value // (99 * 9999), value // 9999 % 99, value % 9999
    return _refill(text, f"{place + 1 + (place > 664):03d}{group + 1:02d}{serial + 1:04d}")


def _ends(kind: str, text: str) -> list[int]:
    """The ends up to which a match may be a value, the likeliest first: where digits or
    words behind a value fit its pattern too, it ends at a border between groups."""
    if kind not in ("phone", "iban"):
        return [len(text)]
    ends = [len(text), *(m.start() for m in reversed(list(_BORDER.finditer(text))))]
    if kind == "iban":
        return sorted(ends, key=lambda e: len(text[:e].replace(" ", "")) != _IBAN_SIZES.get(text[:2]))
    return sorted(ends, key=lambda e: not _exact_phone(text[:e]))


def _exact_phone(text: str) -> bool:
    country = re.match(r"(?:\+|00)(\d{1,3})[ ./(-]", text)
    return bool(country) and len(_DIGITS.findall(text)) - 2 * text.startswith("00") == _PHONE_SIZES.get(country[1])


def pseudonymise(text: str, key: bytes) -> tuple[str, list[tuple]]:
    """The text with pseudonyms, and (kind, start, end, pseudonym) of each in the result."""
    out, spans, at, size = [], [], 0, 0
    for start, end in _places(text):
        while m := _FOUND.search(text, max(start, at), end):
            found = m[0]
            new = None
            for stop in _ends(m.lastgroup, found):
                if (new := pseudonym(m.lastgroup, found[:stop], key)) is not None:
                    break
            start = m.start() + 1
            if new is None:
                continue
            out += [text[at : m.start()], new]
            size += m.start() - at + len(new)
            spans.append((m.lastgroup, size - len(new), size, new))
            at = m.start() + stop
    out.append(text[at:])
    return "".join(out), spans


def _places(text: str):
    """Stretches of the text that may hold values, cut at white space."""
    low = high = -1
    for m in _HINT.finditer(text):
        if m.start() < high:
            continue
        if low >= 0 and m.start() - high > _BRIDGE:
            yield low, high
            low = -1
        if low < 0:
            low = m.start()
            while low > 0 and not text[low - 1].isspace():
                low -= 1
        high = m.end()
        while high < len(text) and not text[high].isspace():
            high += 1
    if low >= 0:
        yield low, high


def mask_personal_data(docs: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """``docs`` with the text pseudonymised and ``pii``: kind, start, end (code points of
    the new text) of each pseudonym. ``pii`` replaces a column of that name.

    Emails, IPv4 addresses, dates, IBANs, social security, phone and card numbers, and
    hexadecimal secrets count; phone numbers are international ones behind + or 00,
    ddd-ddd-dddd and its like, and national ones in groups behind a 0; what fails its
    kind's validation (the check digits of cards and IBANs among it) is left alone. A null text stays null, with no spans; each row is treated for itself, so
    rows that repeat stay alike; an empty table gives an empty result.
    """
    span = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
    kept = [f for f in docs.schema.fields if f.name != "pii"]
    schema = T.StructType([*kept, T.StructField("pii", T.ArrayType(span))])
    types = pa_types(schema)
    at = [f.name for f in kept].index(text_col)
    secret = hashlib.blake2b(key.encode(), digest_size=32).digest()

    def mask(batches):
        for batch in batches:
            texts, spans = [], []
            for text in batch.column(at):
                new, found = (None, []) if text.as_py() is None else pseudonymise(text.as_py(), secret)
                texts.append(new)
                spans.append([{"kind": k, "start": s, "end": e} for k, s, e, _ in found])
            columns = list(batch.columns)
            columns[at] = pa.array(texts, types[at])
            yield pa.RecordBatch.from_arrays([*columns, pa.array(spans, types[-1])], names=schema.names)

    return map_arrow(docs.select(*[column(f.name) for f in kept]), mask, schema)
