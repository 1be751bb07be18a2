"""PII: format-preserving Feistel pseudonyms.

Found and validated: payment card numbers (Luhn), telephone numbers, e-mail addresses, IPv4 addresses (octets to 255), US
social security numbers (valid areas), IBANs (mod 97), dates (real calendar days) and secrets given as `token = "..."` and the
like. Each value is permuted, under a key, within its own format: a card stays a Luhn-valid card with its separators, a date a
date in its notation, hex digits hex digits. The permutation depends on key and kind only, so equal values get equal pseudonyms
in all documents, and different ones different pseudonyms; with the key, back=True inverts it. What doesn't validate stays.
The key is the caller's; the query and the pipeline read it from the setting spark.starloom.pii.key.

Edge cases. A null text stays null, an empty one empty, both with 0 findings. Texts are handled whole, values of any length in
linear time. Repeated rows get equal results. Other columns pass through untouched, whatever their names; the counts are added as n_pii and pii_kinds
(a column of such a name in the input is replaced). An empty table gives an empty result.
"""

from __future__ import annotations

import datetime
import hashlib
import math
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from starloom.llm.common import read, tune

#: The setting that holds the key, and the published example that stands in where it is unset: pseudonyms under that one can be
#: inverted by anyone.
KEY_SETTING, EXAMPLE_KEY = "spark.starloom.pii.key", "starloom-example-key"
ROUNDS = 8
LOWER, DIGITS, HEX = "abcdefghijklmnopqrstuvwxyz", "0123456789", "0123456789abcdef"
DAY0, DAY1 = datetime.date(1900, 1, 1).toordinal(), datetime.date(2099, 12, 31).toordinal()


class Feistel:
    """A keyed permutation of 0 .. size - 1: a balanced Feistel network over the next square, with cycle walking."""

    def __init__(self, key: str, kind: str):
        self.seed = hashlib.blake2b(f"{kind}".encode(), key=hashlib.sha256(key.encode()).digest(), digest_size=32).digest()

    def after(self, before: str) -> Feistel:
        """The permutation of a part that follows `before`."""
        out = object.__new__(Feistel)
        out.seed = hashlib.blake2b(before.encode(), key=self.seed, digest_size=32).digest()
        return out

    def _round(self, r: int, size: int, side: int, x: int) -> int:
        h = hashlib.blake2b(b"%d,%d,%d" % (r, size, x), key=self.seed, digest_size=16).digest()
        return int.from_bytes(h, "big") % side if side < 1 << 60 else int.from_bytes(hashlib.shake_256(h).digest(16 + side.bit_length() // 8), "big") % side

    def permute(self, x: int, size: int, back: bool = False) -> int:
        if size < 2:
            return x
        side = math.isqrt(size - 1) + 1
        while True:
            a, b = divmod(x, side)
            for r in range(ROUNDS - 1, -1, -1) if back else range(ROUNDS):
                if back:
                    a, b = (b - self._round(r, size, side, a)) % side, a
                else:
                    a, b = b, (a + self._round(r, size, side, b)) % side
            x = a * side + b
            if x < size:
                return x


def luhn_digit(body: str) -> str:
    total = 0
    for k, c in enumerate(reversed(body)):
        v = int(c)
        total += v if k % 2 else v * 2 - 9 * (v > 4)
    return str(-total % 10)


def refill(shape: str, chars: str, of: Callable[[str], bool]) -> str:
    """shape with its characters for which `of` holds replaced by chars, in order."""
    it = iter(chars)
    return "".join(next(it) if of(c) else c for c in shape)


def in_radix(f: Feistel, s: str, alphabet: str, back: bool = False) -> str:
    n, base = 0, len(alphabet)
    for c in s:
        n = n * base + alphabet.index(c)
    n = f.permute(n, base ** len(s), back)
    out = []
    for _ in s:
        n, d = divmod(n, base)
        out.append(alphabet[d])
    return "".join(reversed(out))


def card(f: Feistel, s: str, back: bool) -> str | None:
    d = re.sub(r"\D", "", s)
    if not 13 <= len(d) <= 19 or luhn_digit(d[:-1]) != d[-1] or len(set(d)) == 1:
        return None
    body = in_radix(f, d[:-1], DIGITS, back)
    while len(set(body + luhn_digit(body))) == 1:  # not a valid input either, so the walk stays a permutation
        body = in_radix(f, body, DIGITS, back)
    return refill(s, body + luhn_digit(body), str.isdigit)


#: Country codes, where no separator ends them.
COUNTRY = r"\+(?:[17]|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[0-9]{3})"


def phone(f: Feistel, s: str, back: bool) -> str | None:
    """The country code stays, where there is one; all other digits move."""
    head = re.match(r"\+\d{1,3}(?=[ .(-])", s) or re.match(COUNTRY, s)
    head = head[0] if head else ""
    rest = s[len(head) :]
    d = re.sub(r"\D", "", rest)
    if not 7 <= len(d) <= 14:
        return None
    return head + refill(rest, in_radix(f, d, DIGITS, back), str.isdigit)


def email(f: Feistel, s: str, back: bool) -> str | None:
    """Letters and digits of the local part move among letters and digits; the domain stays."""
    local, _, domain = s.rpartition("@")
    digits, letters = "".join(c for c in local if c in DIGITS), "".join(c.lower() for c in local if c.isascii() and c.isalpha())
    if not letters and not digits:
        return None
    n = f.permute(_number(letters, LOWER) * 10 ** len(digits) + _number(digits, DIGITS), 26 ** len(letters) * 10 ** len(digits), back)
    hi, lo = divmod(n, 10 ** len(digits))
    a, b = iter(_string(hi, LOWER, len(letters))), iter(_string(lo, DIGITS, len(digits)))
    new = "".join(next(b) if c in DIGITS else (next(a).upper() if c.isupper() else next(a)) if c.isascii() and c.isalpha() else c for c in local)
    return f"{new}@{domain}"


def _number(s: str, alphabet: str) -> int:
    n = 0
    for c in s:
        n = n * len(alphabet) + alphabet.index(c)
    return n


def _string(n: int, alphabet: str, size: int) -> str:
    out = []
    for _ in range(size):
        n, d = divmod(n, len(alphabet))
        out.append(alphabet[d])
    return "".join(reversed(out))


def ipv4(f: Feistel, s: str, back: bool) -> str | None:
    parts = s.split(".")
    if any(int(p) > 255 or len(p) > 1 and p[0] == "0" for p in parts):
        return None
    n = f.permute(int.from_bytes(bytes(map(int, parts)), "big"), 1 << 32, back)
    return ".".join(map(str, n.to_bytes(4, "big")))


def ssn(f: Feistel, s: str, back: bool) -> str | None:
    area, group, serial = s.split("-")
    valid = lambda a, g, n: a not in ("000", "666") and a < "900" and g != "00" and n != "0000"
    if not valid(area, group, serial):
        return None
    d = area + group + serial
    while True:
        d = in_radix(f, d, DIGITS, back)
        if valid(d[:3], d[3:5], d[5:]):
            return f"{d[:3]}-{d[3:5]}-{d[5:]}"


def iban(f: Feistel, s: str, back: bool) -> str | None:
    """Country and letters stay, digits of the account move, the check digits follow."""
    value = lambda x: int("".join(str(int(c, 36)) for c in x))
    if not 15 <= len(s) <= 34 or value(s[4:] + s[:4]) % 97 != 1:
        return None
    d = "".join(c for c in s[4:] if c in DIGITS)
    body = refill(s[4:], in_radix(f, d, DIGITS, back), lambda c: c in DIGITS)
    return f"{s[:2]}{98 - value(body + s[:2] + '00') % 97:02d}{body}"


def date(f: Feistel, s: str, back: bool) -> str | None:
    """year-month-day, or day/month/year or month/day/year by what the calendar allows; within 1900 to 2099."""
    sep = re.search(r"\D", s)[0]
    a, b, c = s.split(sep)
    orders = [(a, b, c, "ymd")] if len(a) == 4 else [(c, b, a, "dmy"), (c, a, b, "mdy")] if sep == "/" else [(c, b, a, "dmy")]
    for y, m, d, order in orders:
        try:
            day = datetime.date(int(y), int(m), int(d)).toordinal()
        except ValueError:
            continue
        if not DAY0 <= day <= DAY1:
            return None
        while True:
            day = DAY0 + f.permute(day - DAY0, DAY1 - DAY0 + 1, back)
            new = datetime.date.fromordinal(day)
            if order != "mdy" and sep != "/" or order == "dmy" or new.day > 12:
                break  # a month/day date must not read as day/month
        y, m, d = f"{new.year:04d}", f"{new.month:02d}", f"{new.day:02d}"
        return sep.join({"y": y, "m": m, "d": d}[k] for k in order)
    return None


#: Characters of a secret that are permuted as one number; a longer secret is a chain of such parts.
PART = 64
_HEX = re.compile(r"[0-9a-f]+|[0-9A-F]+")


def secret(f: Feistel, s: str, back: bool) -> str | None:
    """Hex digits move among hex digits; otherwise letters among letters of their case, digits among digits.

    Each walk goes on until the new value is of the old one's class, so that it is inverted as such. The parts of a long secret
    are permuted under keys that depend on the part before (of the pseudonym), so the time is linear in its length.
    """
    if not any(c.isalnum() for c in s):
        return None
    kind = _secret_class(s)
    new = s
    while True:
        new = _parts(f, new, kind, back)
        if _secret_class(new) == kind:
            return new


def _secret_class(s: str) -> str:
    """hex, HEX (with a letter, none of lower case) or other."""
    return "other" if not _HEX.fullmatch(s) else "hex" if s == s.lower() else "HEX"


def _parts(f: Feistel, s: str, kind: str, back: bool) -> str:
    out, before = [], ""
    for at in range(0, len(s), PART):
        part, g = s[at : at + PART], f if not at else f.after(before)
        if kind == "other":
            new = email(g, part + "@x", back)
            new = part if new is None else new[:-2]
        else:
            new = in_radix(g, part.lower(), HEX, back)
            new = new.upper() if kind == "HEX" else new
        before = part if back else new
        out.append(new)
    return "".join(out)


#: Kind, pattern and permutation; at one place the first that validates wins.
KINDS: list[tuple[str, str, Callable]] = [
    ("secret", r"(?i:\b(?:token|secret|password|passwd|api[_-]?key|access[_-]?key)\b)\s*[=:]\s*[\"']?(?P<secret>[A-Za-z0-9_\-+/]{16,})", secret),
    ("email", r"(?<![\w.+-])(?P<email>[\w.+-]{1,64}@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24})(?![\w-])", email),
    ("iban", r"(?<![A-Za-z0-9])(?P<iban>[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30})(?![A-Za-z0-9])", iban),
    ("ipv4", r"(?<![\d.])(?P<ipv4>[0-9]{1,3}(?:\.[0-9]{1,3}){3})(?![\d]|\.\d)", ipv4),
    ("date", r"(?<![\d/.-])(?P<date>[12][0-9]{3}-[0-9]{2}-[0-9]{2}|[0-9]{2}/[0-9]{2}/[12][0-9]{3}|[0-9]{2}\.[0-9]{2}\.[12][0-9]{3})(?![\d/-]|\.\d)", date),
    ("ssn", r"(?<![\d-])(?P<ssn>[0-9]{3}-[0-9]{2}-[0-9]{4})(?![\d-])", ssn),
    ("phone", r"(?<![\w.])(?P<phone>\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)[ .-]?)?[0-9]{1,4}(?:[ .-][0-9]{2,4}){1,4}|\+[0-9]{1,3}[ .-]?[0-9]{6,14}|(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4})(?!\d)", phone),
    ("card", r"(?<![\d.])(?P<card>[0-9](?:[ -]?[0-9]){12,18})(?![\d]|\.\d)", card),
]
ANY = re.compile("|".join(p for _, p, _ in KINDS))
#: A text without a match of this has nothing to find: digits or an @ are in every kind but some secrets.
HINT = r"[0-9@]|(?i:token|secret|passw|key)"


class Pseudonyms:
    def __init__(self, key: str, back: bool = False):
        self.back, self.of = back, {k: (Feistel(key, k), f) for k, _, f in KINDS}
        self.value = lru_cache(100_000)(self._value)

    def _value(self, kind: str, s: str) -> str | None:
        f, act = self.of[kind]
        return act(f, s, self.back)

    def shorter(self, s: str) -> tuple[int, str] | None:
        """Length and pseudonym of the longest card that begins s and ends before one of its separators.

        The walk goes on until what follows makes no longer card of the new number either, so that it is found again.
        """
        ends = [m.start() for m in re.finditer(r"[ -]", s) if m.start() >= 13][::-1]
        for k, end in enumerate(ends):
            new = self.value("card", s[:end])
            if new is not None:
                more = [s[end:e] for e in (len(s), *ends[:k])]
                while any(self.value("card", new + x) is not None for x in more):
                    new = self.value("card", new)
                return end, new
        return None

    def replace(self, text: str) -> tuple[str, list[str]]:
        out, kinds, at, pos = [], [], 0, 0
        while m := ANY.search(text, pos):
            kind = m.lastgroup
            new = self.value(kind, m[kind])
            if new is None:
                # Another kind may still begin here or inside.
                for k, p, _ in KINDS[[x for x, *_ in KINDS].index(kind) + 1 :]:
                    m2 = _one(k).match(text, m.start())
                    if m2 and (new := self.value(k, m2[k])) is not None:
                        m, kind = m2, k
                        break
            end = m.end(kind)
            if new is None and (m2 := _one("card").match(text, m.start())) and (got := self.shorter(m2["card"])):
                m, kind, (size, new) = m2, "card", got
                end = m.start(kind) + size
            if new is None:
                pos = m.start() + 1
                while pos < len(text) and text[pos - 1].isalnum() and text[pos].isalnum():
                    pos += 1
                continue
            out += [text[at : m.start(kind)], new]
            kinds.append(kind)
            at = pos = end
        return ("".join([*out, text[at:]]), kinds) if kinds else (text, kinds)


@lru_cache(None)
def _one(kind: str) -> re.Pattern:
    return re.compile(next(p for k, p, _ in KINDS if k == kind))


def key_of(spark: SparkSession) -> str:
    """The key in KEY_SETTING, or else the published example."""
    return spark.conf.get(KEY_SETTING, None) or EXAMPLE_KEY


def pseudonymise(docs: DataFrame, key: str, text: str = "text", back: bool = False) -> DataFrame:
    """docs with `text` pseudonymised under the key, and with n_pii int and pii_kinds (sorted, distinct)."""
    spark = docs.sparkSession
    tune(spark)
    base = docs.drop("n_pii", "pii_kinds")
    place = base.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = Pseudonyms(key, back)
        for batch in batches:
            col = batch.column(place)
            n, found = [0] * len(col), [[] for _ in range(len(col))]
            some = pc.fill_null(pc.match_substring_regex(col, HINT), False).to_pylist()
            if any(some):
                texts = col.to_pylist() if sum(some) * 2 > len(some) else None
                new = {}
                for k in [k for k, x in enumerate(some) if x]:
                    before = texts[k] if texts else col[k].as_py()
                    after, kinds = p.replace(before)
                    if kinds:
                        new[k], n[k], found[k] = after, len(kinds), sorted(set(kinds))
                if new:
                    texts = texts or col.to_pylist()
                    for k, t in new.items():
                        texts[k] = t
                    col = pa.array(texts, col.type)
            columns = [col if k == place else c for k, c in enumerate(batch.columns)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(n, pa.int32()), pa.array(found, pa.list_(pa.string()))], names=[*batch.schema.names, "n_pii", "pii_kinds"])

    from pyspark.sql import types as T

    schema = T.StructType([*base.schema.fields, T.StructField("n_pii", T.IntegerType()), T.StructField("pii_kinds", T.ArrayType(T.StringType()))])
    return base.mapInArrow(run, schema)


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return pseudonymise(docs, key_of(spark))
