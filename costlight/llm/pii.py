"""PII surrogates: keyed, type-consistent replacements of detected entities.

A surrogate is made by a keyed permutation of the entity's own format: letters become letters of the
same script, case and kind (vowel or consonant; other letters stay within their Unicode block), digits
become digits, separators stay, but for a secret without any letter or digit. A permutation
never maps two entities of one format to one surrogate, so distinctness holds without a global
table, and the same entity gets the same surrogate wherever it comes (coreference). Octets of addresses
stay octets, cards keep whether their check digit holds, and given names are replaced by names of the
same gender and script; a permuted unknown name that meets such a list walks on until it leaves it.
A name of one document is replaced there wherever its words stand. checked() verifies distinctness over a whole
table and counts, by document, the entities whose surrogate stands for another entity too.

Looked for: addresses, secrets after a keyword, keys and tokens by their form, private keys, IPv4 and IPv6, cards, IBANs, US
social security numbers, phone numbers, names after a title or that begin with a given name of the list.
"""

from __future__ import annotations

import hashlib
import ipaddress
import math
import re
import sys
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import store

#: A format of at most so many entities is permuted by a table.
SMALL = 4096
#: Bits that a round of the permutation by numbers can change.
ROUND_BITS = 512

#: Given names by gender and script (fixed values).
NAMES = {
    ("f", "latin"): "Alice Anna Barbara Camille Carmen Chloe Elena Emma Eva Ines Julia Laura Lucia Maria Marie Nora Olivia Sofia Susan Ursula".split(),
    ("m", "latin"): "Adam Antoine Bruno Carlos Daniel David Felix Hans James Javier John Jorge Karl Louis Luis Martin Michael Otto Paul Peter".split(),
    ("f", "cyrillic"): "Анна Вера Дарья Елена Ирина Мария Нина Ольга Софья Татьяна".split(),
    ("m", "cyrillic"): "Алексей Андрей Борис Виктор Дмитрий Иван Михаил Олег Павел Сергей".split(),
}
#: Titles and the gender they tell.
TITLES = {"Mr": "m", "Mrs": "f", "Ms": "f", "Miss": "f", "Herr": "m", "Frau": "f", "Mme": "f", "Señor": "m", "Señora": "f", "Sr": "m", "Sra": "f", "Dr": "", "Prof": ""}

#: Alphabets of permuted letters: (vowels, consonants) by script.
ALPHABETS = {"latin": ("aeiou", "bcdfghjklmnpqrstvwxyz"), "cyrillic": ("аеиоуэюя", "бвгджзйклмнпрстфхцчшщ"), "greek": ("αεηιουω", "βγδζθκλμνξπρστφχψ")}
#: Unicode blocks (first, last) of letters that aren't 128 characters from a multiple of 128 on.
BLOCKS = [(0x180, 0x24F), (0x250, 0x2AF), (0x2B0, 0x36F), (0x370, 0x3FF), (0x400, 0x4FF), (0x500, 0x52F), (0x530, 0x58F), (0x590, 0x5FF), (0x600, 0x6FF), (0x700, 0x74F), (0x750, 0x77F), (0x780, 0x7BF), (0x7C0, 0x7FF), (0x10A0, 0x10FF), (0x1100, 0x11FF), (0x1200, 0x137F), (0x13A0, 0x13FF), (0x1E00, 0x1EFF), (0x1F00, 0x1FFF), (0x3040, 0x309F), (0x30A0, 0x30FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xAC00, 0xD7A3), (0x20000, 0x2A6DF)]


def _cased(c: str) -> bool:
    u = c.upper()
    return len(u) == 1 and u != c and u.lower() == c


class _Classes(dict):
    """The characters that one may become; none for what stays. Letters not in ALPHABETS: those of the same block, script, category and case."""

    def __missing__(self, c: str) -> str:
        kind = unicodedata.category(c)
        if kind == "Nd":
            zero = ord(c) - unicodedata.decimal(c)
            self[c] = "".join(chr(zero + k) for k in range(10))
        elif kind[0] == "L":
            for x in (own := self._block(c, kind)):
                self[x] = own
        else:
            self[c] = ""
        return self[c]

    def _block(self, c: str, kind: str) -> str:
        k = bisect_right(BLOCKS, (ord(c), sys.maxunicode)) - 1
        low, high = BLOCKS[k] if k >= 0 and ord(c) <= BLOCKS[k][1] else (ord(c) & ~127, ord(c) | 127)
        cased, stays, script = _cased(c), c.lower() == c, unicodedata.name(c).split()[0]
        block = (chr(x) for x in range(low, high + 1))
        return "".join(x for x in block if unicodedata.category(x) == kind and (x == c or x not in _NAMED_CLASSES) and _cased(x) == cased and (x.lower() == x) == stays and unicodedata.name(x).split()[0] == script)


class _Symbols(dict):
    """For a secret without letters and digits: ASCII symbols become ASCII symbols, others stay in their category and 128 characters."""

    def __missing__(self, c: str) -> str:
        kind = unicodedata.category(c)
        if c.isascii():
            own = "!#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
        else:
            own = "".join(x for x in map(chr, range(ord(c) & ~127, (ord(c) | 127) + 1)) if unicodedata.category(x) == kind and x.lower() == x and not x.isspace())
        self[c] = own if c in own else ""
        return self[c]


_NAMED_CLASSES = {c: x for pair in ALPHABETS.values() for x in pair for c in x} | dict.fromkeys("0123456789", "0123456789")
_CLASS, _SYMBOLS = _Classes(_NAMED_CLASSES), _Symbols()
_HEX_CLASS = dict.fromkeys("0123456789abcdef", "0123456789abcdef") | {":": ""}

_WORD = r"[^\W\d_]"
_EMAIL = r"(?P<email>[\w.%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]*[A-Za-z0-9])+)"
#: What finds each kind, in the order of preference. No kind has a greatest length but those of fixed formats (card,
#: ssn, phone, ip, AKIA). An address starts where its run of local characters does, so each run is read once.
_FINDERS = {
    "email": rf"(?<![\w.%+-]){_EMAIL}",
    "secret": r"(?:(?i:password|passwd|pwd|token|secret|api_?key)\s{0,3}[=:]\s{0,3}[\"']?)(?P<secret>[^\s\"']{6,}+)",
    "pem": r"(?P<pem>(?<=KEY-----)[A-Za-z0-9+/=\s]{16,}+(?=-----END ))",
    "token": r"(?P<token>(?<![0-9A-Za-z])(?:AKIA[0-9A-Z]{16}|(?:sk|pk|rk|ghp|gho|ghs|ghu|xox[abp])[-_][A-Za-z0-9_-]{16,}+|[0-9a-f]{32,}+|[0-9A-F]{32,}+)(?![0-9A-Za-z]))",
    "ipv6": r"(?P<ipv6>(?<![\w:.])[0-9A-Fa-f]{0,4}(?::[0-9A-Fa-f]{0,4}){2,7}(?![\w:]))",
    "digits": "|".join(
        (
            r"(?P<ip>(?<![\d.])(?:25[0-5]|2[0-4]\d|1?\d?\d)(?:\.(?:25[0-5]|2[0-4]\d|1?\d?\d)){3}(?!\.?\d))",
            r"(?P<iban>(?<![0-9A-Za-z])[A-Z]{2}\d\d(?: ?[0-9A-Z]{4}){2,7}(?: ?[0-9A-Z]{1,3})?(?![0-9A-Za-z]))",
            r"(?P<card>(?<!\d)(?:\d{4}(?P<sep>[ -]?)\d{4}(?P=sep)\d{4}(?P=sep)\d{4}|3[47]\d\d(?P<gap>[ -]?)\d{6}(?P=gap)\d{5})(?!\d))",
            r"(?P<ssn>(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-]))",
            r"(?P<phone>(?<![\w(+])(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)[ .-]?|\d{3}[ .-])\d{3,4}[ .-]?\d{3,4}(?!\d)|(?<!\w)\+\d{8,15}(?!\d)|(?<!\w)\+\d{1,3}[ .-]?(?:\(0\)[ .-]?)?\d{1,4}(?:[ .-]?\d{2,5}){2,4}(?!\d))",
        )
    ),
    "name": "|".join(
        (
            rf"(?:\b(?P<title>{'|'.join(TITLES)})\.? +)(?P<name>(?!(?:The|Der|Die|Das|Le|La|El)\b){_WORD}+(?: {_WORD}+)?)",
            rf"\b(?P<given>(?:{'|'.join(n for names in NAMES.values() for n in names)}) (?=[A-ZÀ-ÞА-ЯΑ-Ω]){_WORD}{{2,}})",
        )
    ),
}
TYPES = ("email", "secret", "pem", "token", "ipv6", "ip", "iban", "card", "ssn", "phone", "name")

#: Each of these starts with plain characters, which the search skips to.
_DIGIT, _HEX, _UPPER_HEX = re.compile(r"\d"), re.compile("[0-9a-f][0-9a-f]{31}"), re.compile("[0-9A-F][0-9A-F]{31}")
_PREFIXED = re.compile("(?:sk|pk|rk|gh[opsu]|xox[abp])[-_]")
_COLONS = re.compile("::|:[0-9A-Fa-f]{1,4}:")
_NAMED = re.compile("|".join([*TITLES, *(n for names in NAMES.values() for n in names)]))
_KEYWORDS = ("password", "passwd", "pwd", "token", "secret", "api_key", "apikey")


@lru_cache
def _pattern(*kinds: str) -> re.Pattern:
    return re.compile("|".join(_FINDERS[k] for k in kinds))


def _kinds(text: str) -> list[str]:
    """Keys of _FINDERS that may find something: a kind left out finds nothing in the text."""
    low = text.casefold()
    cues = {
        "email": "@" in text,
        "secret": any(k in low for k in _KEYWORDS),
        "pem": "PRIVATE KEY-----" in text,
        "token": "AKIA" in text or _HEX.search(text) or _UPPER_HEX.search(text) or _PREFIXED.search(text),
        "ipv6": _COLONS.search(text),
        "digits": _DIGIT.search(text),
        "name": _NAMED.search(text),
    }
    return [k for k, found in cues.items() if found]


_REST = re.compile(rf"{_EMAIL}|[\w.%+-]*+")


def _matches(text: str, kinds: list[str]) -> Iterator[re.Match]:
    """The entities from left to right. What one leaves of a run of local characters may be an address too; this is tried once a run."""
    pattern, at, tried = _pattern(*kinds), 0, 0
    while True:
        m = None
        if "email" in kinds and at > tried:
            m = _REST.match(text, at)
            tried = m.end()
        if not (m and m.lastgroup):
            m = pattern.search(text, at)
        if not m:
            return
        if not _holds(m.lastgroup, m[m.lastgroup]):
            at = m.start() + 1
            continue
        yield m
        at = m.end()


def _holds(kind: str, text: str) -> bool:
    """Whether what looks like one kind is one: an IPv6 address that can be read, an IBAN whose check holds."""
    if kind == "ipv6":
        try:
            return len(text) > 4 and bool(ipaddress.IPv6Address(text))
        except ValueError:
            return False
    return kind != "iban" or _iban_check(text) == int(text[2:4])


def _iban_check(text: str) -> int:
    """The check number that an IBAN should have."""
    plain = text.replace(" ", "")
    return 98 - int("".join(str(int(c, 36)) for c in plain[4:] + plain[:2]) + "00") % 97


def _luhn(digits: list[int]) -> int:
    """Check digit for the digits before it."""
    total = 0
    for k, d in enumerate(reversed(digits)):
        d = d * (2 - k % 2)
        total += d - 9 if d > 9 else d
    return -total % 10


def _as_listed(word: str) -> str:
    return word[:1].upper() + word[1:].lower()


def _name_span(text: str, a: int, b: int) -> int:
    """Where a name ends: a second word that begins with a small letter isn't part of it."""
    first, _, second = text[a:b].partition(" ")
    return a + len(first) if second[:1].islower() else b


class Surrogates:
    """Keyed replacements; the same for the same key everywhere."""

    def __init__(self, key: bytes):
        if not key:
            raise ValueError("a secret key is needed: who knows it can undo the surrogates")
        self.key = hashlib.blake2b(key, digest_size=32).digest()
        self.known: dict[tuple[str, str], str] = {}
        self.cycle: dict[str, str] = {}
        self.orders: dict[tuple[str, tuple[int, ...]], dict[int, int]] = {}
        for (gender, script), names in NAMES.items():
            order = sorted(names, key=lambda n: hashlib.blake2b(f"{gender}{script}{n}".encode(), key=self.key).digest())
            self.cycle |= {a: b for a, b in zip(order, order[1:] + order[:1], strict=True)}

    def _round(self, tweak: str, number: int, half: int, other: int) -> int:
        raw = hashlib.blake2b(f"{tweak}/{number}/{half}/{other}".encode(), key=self.key, digest_size=64).digest()
        return int.from_bytes(raw, "big")

    def permute(self, values: list[int], radix: list[int], tweak: str) -> list[int]:
        """A keyed permutation of all sequences with these radixes (Feistel network of ten rounds)."""
        n = len(values)
        size = math.prod(radix) if n < 13 else SMALL + 1
        if size <= SMALL or n == 1:
            # One cycle through all of them, so that nothing stays as it is.
            if (after := self.orders.get((tweak, tuple(radix)))) is None:
                order = sorted(range(size), key=lambda x: self._round(tweak, x, 1, size))
                after = dict(zip(order, order[1:] + order[:1], strict=True))
                if len(self.orders) < 64:
                    self.orders[tweak, tuple(radix)] = after
            number = 0
            for v, r in zip(values, radix, strict=True):
                number = number * r + v
            number, out = after[number], []
            for r in reversed(radix):
                out.append(number % r)
                number //= r
            return out[::-1]
        m = n // 2
        if max(sum((r - 1).bit_length() for r in half) for half in (radix[:m], radix[m:])) > ROUND_BITS:
            return self._permute_long(values, radix, tweak)
        sizes = [1, 1]
        parts = [0, 0]
        for k, (v, r) in enumerate(zip(values, radix, strict=True)):
            h = int(k >= m)
            parts[h] = parts[h] * r + v
            sizes[h] *= r
        for number in range(10):
            h = number % 2
            parts[h] = (parts[h] + self._round(tweak, number, n, parts[1 - h])) % sizes[h]
        out = []
        for h, rs in ((0, radix[:m]), (1, radix[m:])):
            part, x = parts[h], []
            for r in reversed(rs):
                x.append(part % r)
                part //= r
            out += x[::-1]
        return out

    def _permute_long(self, values: list[int], radix: list[int], tweak: str) -> list[int]:
        """The same network for halves that hold more than a round's bits: value by value, in linear time."""
        m = len(values) // 2
        parts = [np.array(x, np.uint32) for x in (values[:m], values[m:])]
        sizes = [np.array(x, np.uint32) for x in (radix[:m], radix[m:])]
        form = hashlib.blake2b(tweak.encode(), key=self.key).digest()
        for number in range(10):
            h = number % 2
            seed = hashlib.blake2b(form + bytes([number]) + parts[1 - h].astype("<u4").tobytes(), key=self.key).digest()
            stream = np.frombuffer(hashlib.shake_256(seed).digest(4 * len(parts[h])), "<u4")
            parts[h] = (parts[h] + stream % sizes[h]) % sizes[h]
        return parts[0].tolist() + parts[1].tolist()

    def shape(self, text: str, tweak: str, alphabets: dict[str, str] | None = None) -> str:
        """Permutes letters and digits within their classes; all else stays, and tells formats apart."""
        low = [c.lower() if len(c.lower()) == 1 else c for c in text]
        classes = _CLASS if alphabets is None else alphabets
        kinds = [classes[c] for c in low]
        at = [k for k, x in enumerate(kinds) if x]
        if not at:
            return text
        form = "".join("?" if x else c for x, c in zip(kinds, low, strict=True)) + "/" + "/".join(kinds[k][0] for k in at)
        new = self.permute([kinds[k].index(low[k]) for k in at], [len(kinds[k]) for k in at], f"{tweak}:{form}")
        out = list(text)
        for k, v in zip(at, new, strict=True):
            c = kinds[k][v]
            out[k] = c.upper() if text[k] != low[k] and _cased(c) else c
        return "".join(out)

    def name(self, text: str) -> str:
        """Word by word, so a part of a name refers to the same person as the whole."""
        return " ".join(self._name_word(w) for w in text.split(" "))

    def _name_word(self, word: str) -> str:
        if (known := _as_listed(word)) in self.cycle:
            out = self.cycle[known]
            return out.upper() if word.isupper() else out.lower() if word.islower() else out
        out = self.shape(word, "name")
        while _as_listed(out) in self.cycle:
            out = self.shape(out, "name")
        return out

    def of(self, kind: str, text: str) -> str:
        if (found := self.known.get((kind, text))) is not None:
            return found
        if kind == "email":
            local, _, domain = text.partition("@")
            head, dot, tld = domain.rpartition(".")
            both = self.shape(f"{local}@{head}", "email")
            out = f"{both}{dot}{tld}"
        elif kind == "ip":
            out = ".".join(map(str, self.permute([int(x) for x in text.split(".")], [256] * 4, "ip")))
        elif kind == "card":
            digits = [int(c) for c in text if c.isdigit()]
            off = (digits[-1] - _luhn(digits[:-1])) % 10
            new = self.permute(digits[:-1], [10] * (len(digits) - 1), "card")
            new.append((_luhn(new) + off) % 10)
            it = iter(new)
            out = "".join(str(next(it)) if c.isdigit() else c for c in text)
        elif kind == "token" and re.fullmatch("[0-9a-f]+|[0-9A-F]+", text):
            out = self.shape(text, "token", _HEX_CLASS)
        elif kind == "token":
            out = text[:4] + self.shape(text[4:], "token")
        elif kind in ("pem", "ipv6"):
            out = self.shape(text, kind, None if kind == "pem" else _HEX_CLASS)
        elif kind == "iban":
            body = self.shape(text[4:], f"iban{text[:2]}")
            out = f"{text[:2]}00{body}"
            out = f"{text[:2]}{_iban_check(out):02d}{body}"
        elif kind == "phone" and text[0] == "+":
            m = re.match(r"\+1(?!\d)|\+\d\d?", text)
            out = m[0] + self.shape(text[m.end() :], f"phone{m[0]}")
        elif kind == "name":
            out = self.name(text)
        elif kind == "secret" and not any(_CLASS[c.lower() if len(c.lower()) == 1 else c] for c in text):
            out = self.shape(text, kind, _SYMBOLS)
        else:
            out = self.shape(text, kind)
        if len(self.known) < 1 << 16 and len(text) <= 1 << 8:
            self.known[kind, text] = out
        return out

    def replace(self, text: str) -> tuple[str, list[tuple[str, int, int, str]]]:
        """The text with surrogates, and (type, start, end, surrogate) of each entity of the given text."""
        if not (kinds := _kinds(text)):
            return text, []
        spans, words = [], set()
        for m in _matches(text, kinds):
            group = m.lastgroup
            a, b = m.span(group)
            if group in ("given", "name"):
                group, b = "name", _name_span(text, a, b)
                words.update(w for w in text[a:b].split(" ") if len(w) > 2 and not w.islower())
            spans.append((group, a, b))
        if words:
            spans = sorted(spans + self._again(text, words, spans), key=lambda x: x[1])
        out, found, at = [], [], 0
        for kind, a, b in spans:
            new = self.of(kind, text[a:b])
            out += [text[at:a], new]
            found.append((kind, a, b, new))
            at = b
        out.append(text[at:])
        return "".join(out), found

    def _again(self, text: str, words: set[str], spans: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
        """Where words of the document's names stand outside of what was found."""
        starts = [a for _, a, _ in spans]
        out = []
        for m in re.finditer(r"[^\W\d_]+", text):
            if m[0] in words:
                k = bisect_right(starts, m.start()) - 1
                if (k < 0 or spans[k][2] <= m.start()) and (k + 1 == len(spans) or starts[k + 1] >= m.end()):
                    out.append(("name", m.start(), m.end()))
        return out


SPANS = "array<struct<type:string,start:int,end:int,surrogate:string>>"


def replace_pii(df: DataFrame, key: bytes, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per row: id_column, text with surrogates, n_entities, entities (places in the given text).

    Null texts stay null and have none; empty texts stay empty. Repeated rows are treated alike; an empty table gives an
    empty result. Very long texts are read in time that grows with their length. Other columns are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = Surrogates(key)
        spans = pa.list_(pa.struct([("type", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("surrogate", pa.string())]))
        for batch in batches:
            texts, found = [], []
            for text in batch.column(1).to_pylist():
                new, own = (None, []) if text is None else make.replace(text)
                texts.append(new)
                found.append([dict(zip(("type", "start", "end", "surrogate"), x, strict=True)) for x in own])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array([len(x) for x in found], pa.int64()), pa.array(found, spans)], names=["id", "text", "n_entities", "entities"])

    Surrogates(key)
    kind = df.schema[id_column].dataType.simpleString()
    out = df.select(F.col(id_column), F.col(text_column).cast("string")).mapInArrow(run, f"id {kind}, text string, n_entities long, entities {SPANS}")
    return out.select(F.col("id").alias(id_column), F.col("text").alias(text_column), "n_entities", "entities")


def _pairs(original: DataFrame, replaced: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """i, type, surrogate and entity (without case) of each entity."""
    spans = replaced.where("n_entities > 0").select(F.col(id_column).alias("i"), F.explode("entities").alias("e"))
    rows = original.select(F.col(id_column).alias("i"), F.col(text_column).alias("t")).join(spans, "i")
    return rows.select("i", F.col("e.type").alias("type"), F.lower("e.surrogate").alias("surrogate"), F.lower(F.expr("substring(t, e.start + 1, e.end - e.start)")).alias("entity"))


def collisions(original: DataFrame, replaced: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Surrogates that stand for more than one entity of a type (compared without case): none are expected."""
    return _pairs(original, replaced, id_column, text_column).distinct().groupBy("type", "surrogate").agg(F.count("*").alias("n")).where("n > 1")


def checked(df: DataFrame, key: bytes, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """replace_pii() and n_collisions: how many of the row's entities have a surrogate that stands for another entity of its type too.

    The rows are written first, with a hash of each entity instead of the entity; a surrogate's hashes are combined before the
    shuffle to the least and the greatest, so that a frequent one makes no large group.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = Surrogates(key)
        for batch in batches:
            out = []
            for text in batch.column(1).to_pylist():
                own = [] if text is None else make.replace(text)
                new, found = own or (None, [])
                out.append((new, [{"type": t, "start": a, "end": b, "surrogate": x, "h": int.from_bytes(hashlib.blake2b(text[a:b].lower().encode(), key=make.key, digest_size=8).digest(), signed=True)} for t, a, b, x in found]))
            spans = pa.list_(pa.struct([("type", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("surrogate", pa.string()), ("h", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], spans)], names=["id", "text", "found"])

    Surrogates(key)
    kind = df.schema[id_column].dataType.simpleString()
    base = df.select(F.col(id_column), F.col(text_column).cast("string")).mapInArrow(run, f"id {kind}, text string, found array<struct<type:string,start:int,end:int,surrogate:string,h:long>>")
    rows, _ = store.write(base, "surrogates")
    each = rows.where(F.size("found") > 0).select(F.explode("found").alias("e")).select("e.type", F.lower("e.surrogate").alias("surrogate"), "e.h")
    double = each.groupBy("type", "surrogate").agg(F.min("h").alias("a"), F.max("h").alias("b")).where("a <> b").select("type", "surrogate")
    entities = F.expr("transform(found, x -> named_struct('type', x.type, 'start', x.start, 'end', x.end, 'surrogate', x.surrogate))")
    out = rows.select(F.col("id").alias(id_column), F.col("text").alias(text_column), F.size("found").cast("long").alias("n_entities"), entities.alias("entities"))
    if double.limit(1).count() == 0:
        return out.withColumn("n_collisions", F.lit(0).cast("long"))
    # Only where there are any: rows are told apart by a number, as ids may repeat.
    marked, _ = store.write(out.withColumn("row", F.monotonically_increasing_id()), "marked")
    hit = marked.select("row", F.explode("entities").alias("e")).select("row", "e.type", F.lower("e.surrogate").alias("surrogate")).join(double, ["type", "surrogate"])
    return marked.join(hit.groupBy("row").agg(F.count("*").alias("n_collisions")), "row", "left").drop("row").withColumn("n_collisions", F.coalesce("n_collisions", F.lit(0)))
