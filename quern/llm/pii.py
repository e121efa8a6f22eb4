"""Format-preserving pseudonyms for personal data (operator 1).

Numbers that pass their check (card numbers by the Luhn rule, IBANs by mod 97, social
security numbers, phone numbers, IPv4 addresses by their ranges), dates that exist and e-mail names are permuted within their
own format by a keyed Feistel network with cycle walking.  So a pseudonym passes the same checks,
equal values get equal pseudonyms in all documents, and the key's holder can undo it.

Equal means the value, not its spelling: a phone number links with and without its country code and
separators, a day links in all date forms (a new day keeps whether day and month take one digit or
two, and whether the day could be a month, so each form stays readable as it was), and an
e-mail name links in upper and lower case.
"""

from __future__ import annotations

import bisect
import datetime
import functools
import hashlib
import math
import re
import secrets
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.common import sliced

#: Session setting that holds the key where the caller gives none.
KEY_SETTING = "spark.quern.pii.key"
ROUNDS = 10
#: First day, and number of days, of the dates that are permuted: 1900-01-01 to 2099-12-31.
FIRST_DAY, DAYS = datetime.date(1900, 1, 1).toordinal(), datetime.date(2100, 1, 1).toordinal() - datetime.date(1900, 1, 1).toordinal()
#: Texts without any of these hold nothing to find.
_HINT = r"\d[\d ()./:-]{5}|@"


class Feistel:
    """A keyed permutation of the whole numbers below n, for any n."""

    def __init__(self, key: bytes, tweak: str, n: int, rounds: int = ROUNDS):
        self.n, self.rounds = n, rounds
        self.a = self.b = math.isqrt(n - 1) + 1
        self.seed = hashlib.blake2b(tweak.encode() + b"\0%d" % n, key=key[:64], digest_size=16).digest()

    def _round(self, k: int, x: int, m: int) -> int:
        return int.from_bytes(hashlib.blake2b(b"%d %d" % (k, x), key=self.seed, digest_size=16).digest(), "big") % m

    def permute(self, x: int) -> int:
        while True:
            left, right = divmod(x, self.b)
            for k in range(self.rounds):
                left, right = right, (left + self._round(k, right, self.a)) % self.a
            if (x := left * self.b + right) < self.n:
                return x

    def restore(self, x: int) -> int:
        while True:
            left, right = divmod(x, self.b)
            for k in reversed(range(self.rounds)):
                left, right = (right - self._round(k, left, self.a)) % self.a, left
            if (x := left * self.b + right) < self.n:
                return x


@functools.lru_cache(maxsize=1024)
def _network(key: bytes, tweak: str, n: int) -> Feistel:
    return Feistel(key, tweak, n)


#: Country calling codes of one and of two digits (fixed values); all others have three.
CALLING_CODES = ("1", "7", *"20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split())


#: Lengths of IBANs by country (fixed values of the public registry).
IBAN_LENGTHS = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BR": 29, "BY": 28, "CH": 21, "CR": 22, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "DO": 28,
    "EE": 20, "EG": 29, "ES": 24, "FI": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23, "GL": 18, "GR": 27, "GT": 28, "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IQ": 23, "IS": 26,
    "IT": 27, "JO": 30, "KW": 30, "KZ": 20, "LB": 28, "LC": 32, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "LY": 25, "MC": 27, "MD": 24, "ME": 22, "MK": 19, "MR": 27, "MT": 31, "MU": 30,
    "NL": 18, "NO": 15, "PK": 24, "PL": 28, "PS": 29, "PT": 25, "QA": 29, "RO": 24, "RS": 22, "SA": 24, "SC": 31, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "ST": 25, "SV": 28, "TL": 23,
    "TN": 24, "TR": 26, "UA": 29, "VA": 22, "VG": 24, "XK": 20,
}


def calling_code(digits: str) -> str:
    """The country code that an international number starts with."""
    return next((digits[:n] for n in (1, 2) if digits[:n] in CALLING_CODES), digits[:3])


def _day_class(day: datetime.date) -> tuple[int, bool]:
    """What a day's spelling shows: digits of its day and month, and whether the day could be a month."""
    return (day.day > 9) + (day.day > 12), day.month > 9


@functools.cache
def _days() -> dict[tuple[int, bool], list[int]]:
    """The days of each class, ascending."""
    out: dict[tuple[int, bool], list[int]] = {}
    for n in range(FIRST_DAY, FIRST_DAY + DAYS):
        out.setdefault(_day_class(datetime.date.fromordinal(n)), []).append(n)
    return out


@functools.lru_cache(maxsize=4096)
def _letters(block: int) -> str:
    """Lower-case letters among the 32 code points of a block outside ASCII that have one upper-case form of their own, or none."""
    chars = map(chr, range(block * 32, block * 32 + 32))
    return "".join(c for c in chars if c.isalpha() and c.lower() == c and (c.upper() == c or len(c.upper()) == 1 and c.upper().lower() == c))


def luhn_digit(payload: str) -> str:
    """Check digit that makes payload + digit pass the Luhn rule."""
    total = sum(d if k % 2 else d * 2 - 9 * (d > 4) for k, d in enumerate(map(int, reversed(payload))))
    return str(-total % 10)


def _iban_check(country: str, account: str) -> str:
    digits = "".join(str(int(c, 36)) for c in account + country + "00")
    return f"{98 - int(digits) % 97:02d}"


def _refill(template: str, symbols: str, is_symbol: Callable[[str], bool] = str.isdigit) -> str:
    """``template`` with its symbols replaced in order; separators stay."""
    it = iter(symbols)
    return "".join(next(it) if is_symbol(c) else c for c in template)


class Pseudonyms:
    """Detects, validates and permutes (or restores) personal data in a text."""

    def __init__(self, key: bytes, restore: bool = False):
        self.key, self.back = key, restore

    def _walk(self, tweak: str, x: int, n: int, valid: Callable[[int], bool] | None = None) -> int:
        net = _network(self.key, tweak, n)
        step = net.restore if self.back else net.permute
        while True:
            x = step(x)
            if valid is None or valid(x):
                return x

    def card(self, s: str) -> str | None:
        d = re.sub(r"\D", "", s)
        if not 13 <= len(d) <= 19 or luhn_digit(d[:-1]) != d[-1] or len(set(d)) < 2:
            return None
        body = d[0] + f"{self._walk(f'card{d[0]}', int(d[1:-1]), 10 ** (len(d) - 2), lambda x: len(set(f'{d[0]}{x:0{len(d) - 2}d}')) > 1):0{len(d) - 2}d}"
        return _refill(s, body + luhn_digit(body))

    def ssn(self, s: str) -> str | None:
        d = re.sub(r"\D", "", s)
        ok = lambda x: x[:3] not in ("000", "666") and x[0] != "9" and x[3:5] != "00" and x[5:] != "0000"
        if not ok(d):
            return None
        return _refill(s, f"{self._walk('ssn', int(d), 10**9, lambda x: ok(f'{x:09d}')):09d}")

    def phone(self, s: str) -> str | None:
        d = re.sub(r"\D", "", s)
        plus = s.startswith("+")
        if plus and calling_code(d) != "1":
            return self._international(s, d)
        head, body = ("1", d[1:]) if plus or len(d) == 11 else ("", d)
        if plus and len(body) != 10:
            return self._international(s, d)
        # a country code leaves no doubt, whatever the area code
        if len(body) != 10 or not plus and (d[:-10] not in ("", "1") or body[0] in "01"):
            return None
        if len(s) == 10 and (body[3] in "01" or body[1:3] == "11" or body[4:6] == "11"):
            return None  # bare digits must be a number of the plan
        kind = self._plan(body)
        return _refill(s, head + f"{self._walk(f'phone{kind}', int(body), 10**10, lambda x: self._plan(f'{x:010d}') == kind):010d}")

    @staticmethod
    def _plan(body: str) -> int:
        """2 for ten digits that are a number of the plan when bare, 1 for those that separators or a country code show to be a phone, 0 for those that only a country code does."""
        if body[0] in "01":
            return 0
        return 1 if body[3] in "01" or body[1:3] == "11" or body[4:6] == "11" else 2

    def _international(self, s: str, d: str) -> str | None:
        code = calling_code(d)
        rest = len(d) - len(code)
        if not 8 <= len(d) <= 15 or rest < 4:
            return None
        return _refill(s, code + f"{self._walk(f'tel{code}', int(d[len(code) :]), 10**rest):0{rest}d}")

    def ipv4(self, s: str) -> str | None:
        parts = s.split(".")
        if any(int(p) > 255 or p != str(int(p)) for p in parts):
            return None
        x = self._walk("ipv4", int.from_bytes(bytes(map(int, parts)), "big"), 1 << 32)
        return ".".join(map(str, x.to_bytes(4, "big")))

    def _date(self, year: str, month: str, day: str) -> datetime.date | None:
        """The new day of the same class, or None if the day does not exist or lies outside FIRST_DAY and DAYS."""
        try:
            old = datetime.date(int(year), int(month), int(day))
        except ValueError:
            return None
        if not 0 <= old.toordinal() - FIRST_DAY < DAYS:
            return None
        kind = _day_class(old)
        days = _days()[kind]
        return datetime.date.fromordinal(days[self._walk(f"date{kind}", bisect.bisect_left(days, old.toordinal()), len(days))])

    def date_iso(self, s: str) -> str | None:
        year, month, day = s.split(s[4])
        new = self._date(year, month, day)
        return new and s[4].join((f"{new.year}", f"{new.month:0{len(month)}d}", f"{new.day:0{len(day)}d}"))

    def date_dmy(self, s: str) -> str | None:
        """Day first where that is a date, else month first; the new day is read in the same order, and each field keeps its digits."""
        sep = re.search(r"\D", s)[0]
        a, b, year = s.split(sep)
        if new := self._date(year, b, a):
            return f"{new.day:0{len(a)}d}{sep}{new.month:0{len(b)}d}{sep}{new.year}"
        if new := self._date(year, a, b):
            return f"{new.month:0{len(a)}d}{sep}{new.day:0{len(b)}d}{sep}{new.year}"
        return None

    def iban(self, s: str) -> str | None:
        c = s.replace(" ", "")
        country, check, account = c[:2], c[2:4], c[4:]
        if not 15 <= len(c) <= 34 or _iban_check(country, account) != check:
            return None
        new = self._mixed(f"iban{country}", account)
        return _refill(s, country + _iban_check(country, new) + new, str.isalnum)

    def _mixed(self, tweak: str, s: str) -> str:
        """Letters to letters and digits to digits of the same kind, all other characters as they are."""
        kinds = []
        for c in s:
            letters = "0123456789" if "0" <= c <= "9" else "abcdefghijklmnopqrstuvwxyz" if "a" <= c <= "z" else "ABCDEFGHIJKLMNOPQRSTUVWXYZ" if "A" <= c <= "Z" else c if c < "\x80" else _letters(ord(c) >> 5)
            kinds.append(letters if c in letters else c)
        x, n = 0, 1
        for c, letters in zip(s, kinds):
            x, n = x * len(letters) + letters.index(c), n * len(letters)
        if n == 1:
            return s
        x = self._walk(f"{tweak}:{''.join(letters[0] for letters in kinds)}", x, n)
        out = []
        for letters in reversed(kinds):
            x, k = divmod(x, len(letters))
            out.append(letters[k])
        return "".join(reversed(out))

    def email(self, s: str) -> str | None:
        """Names are permuted in lower case, so spellings link; each place keeps its case."""
        name, _, host = s.rpartition("@")
        low = [c.lower() if len(c.lower()) == 1 and c.lower().upper() == c else c for c in name]
        new = self._mixed("email", "".join(low))
        return "".join(n.upper() if c != o else n for c, o, n in zip(name, low, new)) + "@" + host

    def _grouped(self, kind: str, s: str) -> str | None:
        """The pseudonym, of equal length, of the start of ``s`` that ends with a group and passes its check.

        An IBAN of its country's length comes first, then the shortest start that passes.  So a value's pseudonym does not depend on what
        follows it (but for an IBAN of another length than its country's), and it is the first to pass again when it is restored.
        """
        check = getattr(self, kind)
        ends = [*(k for k in range(1, len(s)) if s[k] in " -"), len(s)]
        if kind == "iban":
            ends.sort(key=lambda end: sum(map(str.isalnum, s[:end])) != IBAN_LENGTHS.get(s[:2]))
        for k, end in enumerate(ends):
            if (new := check(s[:end])) is None:
                continue
            while any(check((new + s[end:])[:earlier]) is not None for earlier in ends[:k]):
                new = check(new)
            return new
        return None

    #: Kinds in order of precedence, with the pattern of a candidate.
    KINDS = (
        ("email", r"[^\W_][\w.%+-]{0,63}@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}"),
        ("iban", r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b"),
        ("card", r"(?<![\d.-])\d(?:[ -]?\d){12,18}(?![\d-])"),
        ("ipv4", r"(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?![\d]|\.\d)"),
        ("date_iso", r"(?<![\d-])\d{4}(?P<s1>[-/.])\d{1,2}(?P=s1)\d{1,2}(?![\d-])"),
        ("date_dmy", r"(?<![\d./-])\d{1,2}(?P<s2>[/.-])\d{1,2}(?P=s2)\d{4}(?![\d/-])"),
        ("ssn", r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"),
        ("phone", r"\+\d{1,3}[ .-]?(?:\(\d{1,4}\)|\d{1,4})(?:[ .-]?\d{2,4}){1,4}(?!\d)|(?<![\d+-])(?:1[ .-])?(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}(?![\d-])|(?<![\w.+-])[2-9]\d{9}(?![\w-])"),
    )
    _ANY = re.compile("|".join(f"(?P<{k}>{p})" for k, p in KINDS))

    def apply(self, text: str) -> tuple[str, list[tuple[int, int, str]]]:
        """(text with pseudonyms, spans (start, end, kind) of the source that were replaced).

        A candidate that fails its check is left as it is, and the search goes on behind its first character;
        of cards and IBANs the last groups of the candidate may not belong to them (``_grouped``).  Left in clear are numbers that fail their
        check, SSNs with blanks, years of two digits, IBANs in lower case and numbers that start with 00.
        """
        out, spans, at, pos = [], [], 0, 0
        while m := self._ANY.search(text, pos):
            kind = next(k for k, _ in self.KINDS if m[k] is not None)
            grouped = kind in ("card", "iban")
            new = self._grouped(kind, m[0]) if grouped else getattr(self, kind)(m[0])
            if new is None:
                pos = m.start() + 1
                continue
            end = m.start() + len(new) if grouped else m.end()
            out += [text[at : m.start()], new]
            spans.append((m.start(), end, kind))
            at = pos = end
        return "".join([*out, text[at:]]), spans


def _apply(key: bytes, restore: bool, spans_too: bool):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = Pseudonyms(key, restore)
        for batch in batches:
            texts = batch.column("text")
            new, kinds = texts, [None] * batch.num_rows
            hint = pc.fill_null(pc.match_substring_regex(texts, pattern=_HINT), False)
            if pc.any(hint).as_py():
                values = texts.to_pylist()
                for k in pc.indices_nonzero(hint).to_pylist():
                    values[k], spans = work.apply(values[k])
                    kinds[k] = [{"start": a, "end": b, "kind": c} for a, b, c in spans] or None
                new = pa.array(values, texts.type)
            kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string())]))
            cols = [new if n == "text" else c for n, c in zip(batch.schema.names, batch.columns)]
            added = ([pa.array(kinds, kind)], ["pii_spans"]) if spans_too else ([], [])
            yield pa.RecordBatch.from_arrays([*cols, *added[0]], names=[*batch.schema.names, *added[1]])

    return rows


def session_key(spark: SparkSession) -> bytes | None:
    """The key in the session's settings, if any."""
    return key.encode() if (key := spark.conf.get(KEY_SETTING, None)) else None


def fresh_key() -> bytes:
    """A random key."""
    return secrets.token_bytes(32)


def pseudonymise(docs: DataFrame, key: bytes | None = None, restore: bool = False, spans: bool = True) -> DataFrame:
    """``docs`` with personal data in ``text`` replaced, and with ``spans`` pii_spans of what was replaced (null: nothing).

    The key comes from the caller or from KEY_SETTING; without one this fails.  All other columns stay.
    Null and empty texts stay as they are, repeated rows repeat, ties need no order.  ``restore`` undoes it
    under the same key.  One pass, no shuffle; a text of any length is one value in one task.  With ``spans`` a column
    pii_spans of ``docs`` itself is replaced.
    """
    if not (key := key or session_key(docs.sparkSession)):
        raise ValueError(f"no key for pseudonyms: pass one or set {KEY_SETTING}")
    docs = docs.drop("pii_spans") if spans else docs
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    added = ", pii_spans array<struct<start:int,end:int,kind:string>>" if spans else ""
    return docs.mapInArrow(sliced(_apply(key, restore, spans)), fields + added)


def pii_report(docs: DataFrame, key: bytes | None = None) -> DataFrame:
    """(doc_id, text, n_pii, kinds, spans) of every row: the text with pseudonyms and what was replaced."""
    out = pseudonymise(docs.select("doc_id", "text"), key)
    kinds = F.array_join(F.array_sort(F.array_distinct(F.col("pii_spans.kind"))), ",")
    return out.select("doc_id", "text", F.greatest(F.coalesce(F.size("pii_spans"), F.lit(0)), F.lit(0)).alias("n_pii"), F.coalesce(kinds, F.lit("")).alias("kinds"), F.col("pii_spans").alias("spans"))
