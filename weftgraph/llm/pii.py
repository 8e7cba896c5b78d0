"""Format-preserving pseudonyms for personal data.

Numbers and dates that validate (cards by Luhn, IBANs by mod 97, IPv4 octets, phone and social-security number plans, calendar
dates), mail addresses, access tokens and other secrets are replaced by a keyed permutation of their own format: a Feistel network over the
mixed radix of the value's digits and letters, walked until the result validates again. Numbers of a format that may also be invalid (accounts
without a check digit, phone numbers outside the plan) are walked until the result is invalid too, so the permutation is a bijection for each kind and
length: equal values stay equal across documents, different ones stay different.

A date has one pseudonym in all its forms. d/m/yyyy is read first; m/d/yyyy only where that is no date, and dates after the 12th, the only ones that such a
form can hold, are permuted among themselves.

A match is tried at all its groups: an IBAN or a card inside a longer run of groups is found whatever stands before or after it.

Defined results: null text stays null, empty text stays empty. Numbers that don't validate stay, but for runs of 13 to 19 digits,
which are treated as account numbers. Values that touch a letter, digit or dot on either side are part of something
longer and stay. The scan is narrow: no shuffle, no state, texts of any length; repeated rows get equal results, an empty table an empty one. Other
columns pass through; one of the name of `spans` is replaced.
"""

from __future__ import annotations

import datetime
import hashlib
import re
import secrets
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from weftgraph.llm.common import map_texts

ROUNDS = 10
KINDS = ("email", "token", "secret", "iban", "date", "ipv4", "ssn", "phone", "card")
_CUE = re.compile(r"[0-9@]")
_FIND = re.compile(
    r"(?P<email>(?<![\w.+-])[A-Za-z0-9][\w.+-]*@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}(?![\w-]))"
    r"|(?P<token>(?<![\w-])(?:A[KS]IA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|github_pat_[A-Za-z0-9]{22}_[A-Za-z0-9]{59}|glpat-[\w-]{20}|[sr]k_(?:live|test)_[A-Za-z0-9]{24,}|xox[abprs]-[A-Za-z0-9-]{10,}|AIza[\w-]{35})(?![\w-]))"
    r"|(?P<secret>(?<!\w)(?=[0-9a-fA-F]*[0-9])(?:[0-9a-f]{64}|[0-9a-f]{40}|[0-9a-f]{32}|[0-9A-F]{64}|[0-9A-F]{40}|[0-9A-F]{32})(?!\w))"
    r"|(?P<iban>(?<!\w)[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}(?!\w))"
    r"|(?P<date>(?<![\w./-])(?:[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}|[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}|[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{4})(?![\w/-]|\.[0-9]))"
    r"|(?P<ipv4>(?<![\w.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![\w-]|\.[0-9]))"
    r"|(?P<ssn>(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-]))"
    r"|(?P<card>(?<![\w.+-])[0-9](?:[ -]?[0-9]){12,18}(?![\w]|[.-][0-9]))"
    r"|(?P<phone>(?<![\w.+])(?:(?:\+[0-9]{1,3}[ .-]?(?:\(0\) ?)?[0-9]{1,2}|0[0-9])(?P<gap>[ .-])[0-9]{2}(?:(?P=gap)[0-9]{2}){3}"  # 06 12 34 56 78
    r"|(?:\+[0-9]{1,3}[ .-]?)?(?:[6-9][0-9]{2}[ .-][0-9]{2}|[89][0-9][ .-][0-9]{3})(?:[ .-][0-9]{2}){2}"  # 612 34 56 78, 91 123 45 67
    r"|(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,4}\)|[0-9]{2,4})[ .-]?[0-9]{3,4}[ .-]?[0-9]{3,4})(?![\w]|[.-][0-9]))"
)
_RADIX = {**{c: (10, ord(c) - 48, "0") for c in "0123456789"}, **{chr(97 + i): (26, i, "a") for i in range(26)}, **{chr(65 + i): (26, i, "A") for i in range(26)}}
_LENGTHS = {15: "NO", 16: "BE", 18: "DK FI FO GL NL", 19: "MK SI", 20: "AT BA EE KZ LT LU XK", 21: "CH CR HR LI LV", 22: "BG BH DE GB GE IE ME RS VA",
            23: "AE GI IL IQ TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "PT ST", 26: "IS TR", 27: "FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB PL SV",
            29: "BR EG PS QA UA", 30: "JO KW MU", 31: "MT SC", 32: "LC"}
_IBAN_LENGTH = {c: n for n, countries in _LENGTHS.items() for c in countries.split()}
_FIRST_DAY, _LAST_DAY = datetime.date(1900, 1, 1).toordinal(), datetime.date(2099, 12, 31).toordinal()


class Feistel:
    """Keyed permutations; key: any bytes."""

    def __init__(self, key: bytes):
        self.key = hashlib.blake2b(key, digest_size=32).digest()

    def _round(self, i: int, value: int, tweak: bytes) -> int:
        data = tweak + bytes([i]) + value.to_bytes((value.bit_length() + 7) // 8 or 1, "big")
        return int.from_bytes(hashlib.blake2b(data, key=self.key, digest_size=48).digest(), "big")

    def pair(self, a: int, b: int, size_a: int, size_b: int, tweak: bytes) -> tuple[int, int]:
        """A permutation of [0, size_a) x [0, size_b)."""
        for i in range(ROUNDS):
            if i % 2:
                b = (b + self._round(i, a, tweak)) % size_b
            else:
                a = (a + self._round(i, b, tweak)) % size_a
        return a, b

    def number(self, x: int, size: int, tweak: bytes) -> int:
        """A permutation of [0, size), by walking cycles of a slightly larger rectangle."""
        side = 1
        while side * side < size:
            side *= 2
        rows = -(-size // side)
        while True:
            a, b = self.pair(x // side, x % side, rows, side, tweak)
            x = a * side + b
            if x < size:
                return x

    def text(self, value: str, tweak: bytes, hexadecimal: bool = False) -> str:
        """A permutation of the strings with the same pattern of digits, lower and upper letters; other characters stay."""
        places = [(16, "0123456789abcdef".index(c), "x") if hexadecimal else _RADIX.get(c) for c in value]
        used = [i for i, p in enumerate(places) if p]
        if not used:
            return value
        halves = [used[: len(used) // 2], used[len(used) // 2 :]]
        sizes, numbers = [], []
        for half in halves:
            size, x = 1, 0
            for i in half:
                size, x = size * places[i][0], x * places[i][0] + places[i][1]
            sizes.append(size)
            numbers.append(x)
        shape = "".join(p[2] if p else "-" for p in places).encode()
        numbers = list(self.pair(numbers[0], numbers[1], sizes[0], sizes[1], tweak + b"|" + shape + b"|"))
        out = list(value)
        for half, x in zip(halves, numbers, strict=True):
            for i in reversed(half):
                radix, _, base = places[i]
                x, d = divmod(x, radix)
                out[i] = "0123456789abcdef"[d] if base == "x" else chr(ord(base) + d)
        return "".join(out)

    def walk(self, value: str, tweak: bytes, valid: Callable[[str], bool]) -> str:
        """text() again and again until the result validates; value itself must validate."""
        value = self.text(value, tweak)
        while not valid(value):
            value = self.text(value, tweak)
        return value


def luhn_digit(digits: str) -> str:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 if i % 2 == 0 else 1)
        total += d - 9 if d > 9 else d
    return str(-total % 10)


def _mod97(iban: str) -> int:
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97


def _refill(shape: str, digits: str) -> str:
    """shape with its letters and digits replaced, in order."""
    it = iter(digits)
    return "".join(next(it) if c.isalnum() else c for c in shape)


#: What a maker returns: start and end of the value inside the match, and its pseudonym; None where nothing validates.
Made = tuple[int, int, str] | None


def _whole(v: str, new: str) -> Made:
    return 0, len(v), new


def _email(v: str, f: Feistel) -> Made:
    local, _, domain = v.partition("@")
    return _whole(v, f"{f.text(local, b'email')}@{domain}")


def _token(v: str, f: Feistel) -> Made:
    lead = re.match(r"A[KS]IA|gh._|github_pat_|glpat-|.k_...._|xox.-|AIza", v)[0]
    return _whole(v, lead + f.text(v[len(lead) :], b"token" + lead.encode()))


def _secret(v: str, f: Feistel) -> Made:
    new = f.text(v.lower(), b"secret", hexadecimal=True)
    return _whole(v, new if v == v.lower() else new.upper())


def luhn_ok(digits: str) -> bool:
    return luhn_digit(digits[:-1]) == digits[-1]


def _windows(v: str, sep: str, least: int, most: int) -> list[tuple[int, int, str]]:
    """(start, end, characters without separators) of the runs of whole groups of v with least to most characters."""
    groups = [(m.start(), m.end()) for m in re.finditer(rf"[^{sep}]+", v)]
    out = []
    for i, (a, _) in enumerate(groups):
        for _, b in groups[i:]:
            body = re.sub(rf"[{sep}]", "", v[a:b])
            if least <= len(body) <= most:
                out.append((a, b, body))
    return out


def _card(v: str, f: Feistel) -> Made:
    # the earliest card; of those that start together the one of its issuer's length, then the longest
    usual = {"3": 15}
    valid = [(a, len(d) != usual.get(d[0], 16), a - b, b, d) for a, b, d in _windows(v, " -", 13, 19) if luhn_ok(d)]
    if valid:
        a, _, _, b, d = min(valid)
        body = f.text(d[:-1], b"card")
        return a, b, _refill(v[a:b], body + luhn_digit(body))
    d = re.sub(r"[ -]", "", v)
    return _whole(v, _refill(v, f.walk(d, b"account", lambda x: not luhn_ok(x))))


def _iban(v: str, f: Feistel) -> Made:
    known = [(a, b, d) for a, b, d in _windows(v, " ", 15, 34) if d[:2].isalpha() and d[2:4].isdigit() and _IBAN_LENGTH.get(d[:2], len(d)) == len(d) and _mod97(d) == 1]
    if not known:
        return None
    a, b, d = min(known, key=lambda x: (x[0], -x[1]))
    body = f.text(d[4:], b"iban" + d[:2].encode())
    return a, b, _refill(v[a:b], d[:2] + f"{98 - _mod97(d[:2] + '00' + body):02d}" + body)


def _ipv4(v: str, f: Feistel) -> Made:
    octets = [int(x) for x in v.split(".")]
    if max(octets) > 255 or any(len(x) > 1 and x[0] == "0" for x in v.split(".")):
        return None
    x = f.number(int.from_bytes(bytes(octets), "big"), 1 << 32, b"ipv4")
    return _whole(v, ".".join(str(b) for b in x.to_bytes(4, "big")))


def _date(v: str, f: Feistel) -> Made:
    form = "%Y-%m-%d" if "-" in v else "%d/%m/%Y" if "/" in v else "%d.%m.%Y"
    for form in (form, "%m/%d/%Y") if "/" in v else (form,):
        try:
            day = datetime.datetime.strptime(v, form).date()
        except ValueError:
            continue
        if _FIRST_DAY <= day.toordinal() <= _LAST_DAY:
            new, late = day, day.day > 12
            while new is day or (new.day > 12) != late:
                new = datetime.date.fromordinal(_FIRST_DAY + f.number(new.toordinal() - _FIRST_DAY, _LAST_DAY - _FIRST_DAY + 1, b"date"))
            out = new.strftime(form)
            return _whole(v, re.sub(r"\b0", "", out) if len(v) < 10 else out)
    return None


def _ssn_ok(d: str) -> bool:
    return d[:3] not in ("000", "666") and d[0] != "9" and d[3:5] != "00" and d[5:] != "0000"


def _ssn(v: str, f: Feistel) -> Made:
    d = v.replace("-", "")
    return _whole(v, _refill(v, f.walk(d, b"ssn", _ssn_ok))) if _ssn_ok(d) else None


def _nanp_ok(d: str) -> bool:
    return len(d) == 10 and d[0] in "23456789" and d[3] in "23456789"


def _phone(v: str, f: Feistel) -> Made:
    code = re.match(r"\+[0-9]{1,3}(?=[ .(-])|\+", v)
    lead = code[0] if code else ""
    d = re.sub(r"\D", "", v[len(lead) :])
    if not 9 <= len(d) <= 12 and not (lead and 7 <= len(d) <= 13) or not lead and not re.search(r"[ .()-]", v):
        return None
    ok = _nanp_ok(d)
    new = f.walk(d, b"phone", lambda x: _nanp_ok(x) == ok)
    return _whole(v, lead + _refill(v[len(lead) :], new))


_MAKE = {"email": _email, "token": _token, "secret": _secret, "iban": _iban, "date": _date, "ipv4": _ipv4, "ssn": _ssn, "phone": _phone, "card": _card}


def pseudonymize_text(text: object, feistel: Feistel) -> tuple[str | None, list[tuple[str, int, int]]]:
    """(new text, [(kind, start, end in the new text)])."""
    if not isinstance(text, str):
        return None, []
    if not _CUE.search(text):
        return text, []
    out: list[str] = []
    found: list[tuple[str, int, int]] = []
    at = length = 0
    m = _FIND.search(text)
    while m:
        made = _MAKE[m.lastgroup](m[0], feistel)
        if made is None:  # a later group of the match may start a value of its own
            m = _FIND.search(text, m.start() + len(re.match(r"\w+|.", m[0], re.S)[0]))
            continue
        start, end, new = m.start() + made[0], m.start() + made[1], made[2]
        out += [text[at:start], new]
        length += start - at
        found.append((m.lastgroup, length, length + len(new)))
        length += len(new)
        at = end
        m = _FIND.search(text, end)
    return ("".join(out) + text[at:], found) if found else (text, [])


def session_key(spark: SparkSession) -> bytes:
    """The key of the setting `spark.weftgraph.pii.key`; without one, a random key that holds for this session (and is written nowhere else)."""
    name = "spark.weftgraph.pii.key"
    key = spark.conf.get(name, None)
    if not key:
        key = secrets.token_hex(32)
        spark.conf.set(name, key)
    return key.encode()


def pseudonymize(docs: DataFrame, key: bytes, *, text: str = "text", spans: str | None = "pii") -> DataFrame:
    """docs with personal data in text replaced, and (unless spans is None) an array of kind, start and end of each pseudonym. key: secret bytes; who has it can undo the pseudonyms."""
    if not key:
        raise ValueError("a key is needed")

    def make() -> Callable[[list], list]:
        feistel = Feistel(key)

        def go(texts: list) -> list:
            done = [pseudonymize_text(t, feistel) for t in texts]
            found = [[{"kind": k, "start": a, "end": b} for k, a, b in d[1]] for d in done]
            return [[d[0] for d in done], found] if spans else [[d[0] for d in done]]

        return go

    new: dict = {text: ("string", pa.string())}
    if spans:
        item = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])
        new[spans] = ("array<struct<kind:string,start:int,end:int>>", pa.list_(item))
    return map_texts(docs, text, make, new)
