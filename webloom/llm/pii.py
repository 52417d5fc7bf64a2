"""Format-preserving pseudonyms for personal data, by keyed Feistel permutations.

What a validator accepts is replaced by another valid value of the same format: payment cards
(Luhn digit recomputed), bank accounts (IBAN, check digits recomputed), social security and
telephone numbers, IPv4 addresses, dates (another day of 1900 to 2099 in the same notation,
the same one in whichever notation it comes),
e-mail addresses (top-level domain kept), access keys, and the values of password and token
assignments. Each format is a finite domain, and the replacement a permutation of it: an
unbalanced Feistel network of ``ROUNDS`` rounds over mixed-radix numbers, keyed by BLAKE2b,
walked on until the value is valid. So equal values get equal pseudonyms in whatever
document, place or separators; different ones stay different; the key alone undoes it, but
where a number stands beside digits or capitals with which its pseudonym happens to be valid.

Defined results: null and empty texts stay; an empty table stays empty; text without valid values comes out unchanged,
letter by letter; a number that no validator accepts stays, but shorter ends (an IBAN's by its
country's length) and later beginnings in it are tried; addresses are four octets of 0 to 255 without
leading zeros; +1 or a bracketed area code and ten digits are a telephone number, while ten
bare digits in groups need an area code and exchange that don't begin with 0 or 1, and ten
digits in a row are none; of a date's numbers under ten either all have a zero before them or none; where candidates overlap the one
that begins first wins, then the order of ``FINDERS``; scanning is linear in the text, however
long; repeated rows come out alike; other columns are untouched but for ``n_chars``, which,
where it is there, follows the new text; ``n_pii`` replaces a column of that name.
"""

from __future__ import annotations

import datetime
import re
import string
from collections.abc import Callable, Iterator
from functools import lru_cache
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame

ROUNDS = 10
#: For queries and tests; whoever keeps pseudonyms passes a secret of their own.
PUBLIC_KEY = b"webloom: a public key, for demonstration"

DIGITS, LOWER, UPPER = string.digits, string.ascii_lowercase, string.ascii_uppercase
#: Country codes of two digits; 1 and 7 have one, all others three.
SHORT_CODES = frozenset("20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split())
FIRST_DAY, DAYS = datetime.date(1900, 1, 1).toordinal(), 73049


class Feistel:
    """Keyed permutations of the numbers below any bound."""

    def __init__(self, key: bytes):
        self.key = blake2b(key, digest_size=32).digest()

    def _round(self, tweak: bytes, i: int, value: int, bound: int) -> int:
        data = b"%s|%d|%d" % (tweak, i, value)
        n = blake2b(data, key=self.key, digest_size=64).digest()
        bits = bound.bit_length() + 64
        while len(n) * 8 < bits:
            n += blake2b(n[-64:] + data, key=self.key, digest_size=64).digest()
        return int.from_bytes(n, "big") % bound

    def _once(self, x: int, a: int, b: int, tweak: bytes, undo: bool) -> int:
        left, right = divmod(x, b)
        for i in reversed(range(ROUNDS)) if undo else range(ROUNDS):
            if i % 2:
                step = self._round(tweak, i, left, b)
                right = (right - step if undo else right + step) % b
            else:
                step = self._round(tweak, i, right, a)
                left = (left - step if undo else left + step) % a
        return left * b + right

    def permuted(self, x: int, bound: int, tweak: bytes, valid: Callable[[int], bool] = lambda _: True, undo: bool = False) -> int:
        """Where ``x`` goes among the valid numbers below ``bound``."""
        b = max(2, int(bound**0.5) if bound < 1 << 52 else 1 << (bound.bit_length() // 2))
        a = max(2, -(-bound // b))
        while True:
            x = self._once(x, a, b, tweak, undo)
            if x < bound and valid(x):
                return x

    def symbols(self, text: str, alphabets: list[str], tweak: bytes, valid: Callable[[str], bool] = lambda _: True, undo: bool = False) -> str:
        """Permutes a string whose i-th symbol is of the i-th alphabet."""
        bound, x = 1, 0
        for c, alphabet in zip(text, alphabets):
            x, bound = x * len(alphabet) + alphabet.index(c), bound * len(alphabet)
        if bound < 2:
            return text

        def spelled(n: int) -> str:
            out = []
            for alphabet in reversed(alphabets):
                n, i = divmod(n, len(alphabet))
                out.append(alphabet[i])
            return "".join(reversed(out))

        return spelled(self.permuted(x, bound, tweak, lambda n: valid(spelled(n)), undo))


def alphabet_of(c: str) -> str:
    return DIGITS if c in DIGITS else LOWER if c in LOWER else UPPER if c in UPPER else c


def refilled(shape: str, symbols: str, wanted: Callable[[str], bool]) -> str:
    """``shape`` with its wanted characters replaced in order."""
    given = iter(symbols)
    return "".join(next(given) if wanted(c) else c for c in shape)


def luhn_digit(digits: str) -> str:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (2 - i % 2)
        total += n - 9 * (n > 9)
    return str(-total % 10)


def iban_checks(country: str, account: str) -> str:
    number = int("".join(str(int(c, 36)) for c in account + country + "00"))
    return f"{98 - number % 97:02d}"


def area(n: str) -> bool:
    return n[0] not in "01" and n[3] not in "01"


class Pseudonyms:
    """Finds and replaces; ``undo`` gives the original back."""

    def __init__(self, key: bytes = PUBLIC_KEY, undo: bool = False):
        self.feistel, self.undo = Feistel(key), undo
        self.replaced = lru_cache(100_000)(self._replaced)

    def _walk(self, text: str, alphabets: list[str], tweak: str, valid: Callable[[str], bool] = lambda _: True) -> str:
        return self.feistel.symbols(text, alphabets, f"{tweak}:{len(text)}".encode(), valid, self.undo)

    def card(self, m: str) -> str | None:
        digits = "".join(c for c in m if c in DIGITS)
        if not 13 <= len(digits) <= 19 or digits[0] == "0" or luhn_digit(digits[:-1]) != digits[-1]:
            return None
        body = self._walk(digits[:-1], [DIGITS] * (len(digits) - 1), "card", lambda x: x[0] != "0")
        return refilled(m, body + luhn_digit(body), DIGITS.__contains__)

    def iban(self, m: str) -> str | None:
        flat = m.replace(" ", "")
        country, checks, account = flat[:2], flat[2:4], flat[4:]
        if not 11 <= len(account) <= 30 or iban_checks(country, account) != checks:
            return None
        account = self._walk(account, [alphabet_of(c) for c in account], "iban" + country + "".join("9" if c in DIGITS else "A" for c in account))
        return refilled(m, country + iban_checks(country, account) + account, lambda c: c != " ")

    def ssn(self, m: str) -> str | None:
        digits = m.replace("-", "")
        valid = lambda n: n[:3] not in ("000", "666") and n[0] != "9" and n[3:5] != "00" and n[5:] != "0000"
        return refilled(m, self._walk(digits, [DIGITS] * 9, "ssn", valid), DIGITS.__contains__) if valid(digits) else None

    def phone(self, m: str) -> str | None:
        digits = "".join(c for c in m if c in DIGITS)
        if m[0] == "+" and digits[0] != "1":
            if not 8 <= len(digits) <= 15:
                return None
            code = digits[: 1 if digits[0] == "7" else 2 if digits[:2] in SHORT_CODES else 3]
            national = digits[len(code) :]
            return refilled(m, code + self._walk(national, [DIGITS] * len(national), "phone" + code), DIGITS.__contains__)
        code, number = digits[:-10], digits[-10:]
        if len(number) < 10 or code not in ("", "1") or not (area(number) or m[0] in "+("):
            return None
        # what reads as a number without +1 or brackets goes to such, and the rest to the rest
        usual = area(number)
        return refilled(m, code + self._walk(number, [DIGITS] * 10, "phone1", lambda n: area(n) == usual), DIGITS.__contains__)

    def ipv4(self, m: str) -> str | None:
        parts = [int(x) for x in m.split(".")]
        if max(parts) > 255 or any(len(x) > 1 and x[0] == "0" for x in m.split(".")):
            return None
        x = int.from_bytes(bytes(parts), "big")
        x = self.feistel.permuted(x, 1 << 32, b"ipv4", undo=self.undo)
        return ".".join(str(b) for b in x.to_bytes(4, "big"))

    def date(self, m: str) -> str | None:
        a, sep, b, _, c = re.split(r"([-/.])", m)
        orders = ("ymd",) if len(a) == 4 else ("dmy", "mdy") if sep != "-" else ("dmy",)
        for order in orders:
            got = dict(zip(order, (a, b, c)))
            try:
                day = datetime.date(int(got["y"]), int(got["m"]), int(got["d"]))
            except ValueError:
                continue
            if not 1900 <= day.year <= 2099:
                continue
            short = [len(got[x]) == 1 for x in "md" if int(got[x]) < 10]
            if len(set(short)) > 1:
                continue
            # a day goes to one that reads in the same notations: over 12 or not, and with a
            # number of one digit or not; so it is the same one in all notations
            kind = lambda d: (d.day > 12, min(d.day, d.month) < 10)
            valid = lambda n, own=kind(day): kind(datetime.date.fromordinal(FIRST_DAY + n)) == own
            n = self.feistel.permuted(day.toordinal() - FIRST_DAY, DAYS, b"date", valid, self.undo)
            new, width = datetime.date.fromordinal(FIRST_DAY + n), 1 if any(short) else 2
            text = {"y": f"{new.year:04d}", "m": f"{new.month:0{width}d}", "d": f"{new.day:0{width}d}"}
            return sep.join(text[x] for x in order)
        return None

    def email(self, m: str) -> str | None:
        local, _, domain = m.rpartition("@")
        host, _, top = domain.rpartition(".")
        return f"{self.name(local, 'local')}@{self.name(host, 'host')}.{top}"

    def name(self, text: str, tweak: str) -> str:
        """Letters and digits go to such, whatever the case, which is kept."""
        low = "".join(c.lower() for c in text if c in string.ascii_letters or c in DIGITS)
        if not low:
            return text
        shape = "".join("9" if c in DIGITS else "a" for c in low)
        new = self._walk(low, [alphabet_of(c) for c in low], tweak + shape)
        out = refilled(text, new, lambda c: c in string.ascii_letters or c in DIGITS)
        return "".join(o.upper() if c in UPPER else o for c, o in zip(text, out))

    def access_key(self, m: str) -> str | None:
        return m[:4] + self._walk(m[4:], [UPPER + DIGITS] * (len(m) - 4), "access")

    def secret(self, m: str) -> str | None:
        head, value = re.match(r"([A-Za-z_]+\s{0,3}[=:]\s{0,3}[\"']?)(.*)", m, re.S).groups()
        hexa = all(c in "0123456789abcdef" for c in value)
        alphabets = ["0123456789abcdef"] * len(value) if hexa else [alphabet_of(c) for c in value]
        return head + self._walk(value, alphabets, "secret" + ("x" if hexa else "".join("9Aa"[(c in UPPER) + 2 * (c in LOWER)] if len(alphabet_of(c)) > 1 else c for c in value)))

    def _replaced(self, kind: str, value: str) -> str | None:
        return getattr(self, kind)(value)

    def _at(self, text: str, m: re.Match) -> Iterator[tuple[int, int, str]]:
        """What is valid where ``m`` begins, if anything: of each kind the longest match, then
        the shorter ones."""
        start = m.start()
        for kind in list(FINDERS)[list(FINDERS).index(m.lastgroup) :]:
            whole = m if kind == m.lastgroup else ALONE[kind].match(text, start)
            if not whole:
                continue
            if (new := self.replaced(kind, whole[0])) is not None and kind not in ("card", "iban"):
                yield start, whole.end(), new
                return
            ends = [e for e in range(whole.end(), start + 6, -1) if text[e - 1] not in " -." and TAILS[kind].match(text, e) and BODIES[kind].fullmatch(text, start, e)]
            if kind == "iban" and (sized := IBANS.get(text[start : start + 2])) and (x := sized.match(text, start)):
                ends.insert(0, x.end())
            if kind == "card":
                ends = self._card_ends(text, start, whole.end(), ends)
            for end in ends:
                if (new := self.replaced(kind, text[start:end])) is not None:
                    yield start, end, new
                    return

    def _card_ends(self, text: str, start: int, whole: int, ends: list[int]) -> list[int]:
        """In the order to try: usual groupings first, 16 digits before others; then, unless a
        card in a usual grouping begins further on, the whole match, and what is cut off it
        where no group but the last is of less than three digits."""
        usual = [e for e in ends if CARD_FORM.fullmatch(text, start, e)]
        usual.sort(key=lambda e: sum(c in DIGITS for c in text[start:e]) != 16)
        at = start + 1
        while (m := CARD_16.search(text, at, min(len(text), whole + 20))) and m.start() < whole:
            if self.replaced("card", m[0]) is not None:
                return usual
            at = m.start() + 1
        head = text[start : start + 3]
        short = " " in head or "-" in head
        long = lambda e: not short and all(len(g) > 2 for g in re.split("[ -]", text[start:e])[:-1])
        return usual + [e for e in ends if e not in usual and (e == whole or long(e))]

    def of(self, text: str) -> tuple[str, int]:
        """The text with pseudonyms, and how many there are."""
        spans: list[tuple[int, int, str]] = []
        if HAS_SECRET.search(text):
            spans += [(m.start(), m.end(), new) for m in SECRET.finditer(text) if (new := self.replaced("secret", m[0])) is not None]
        at = text.find("@")
        while at >= 0:
            left = LOCAL.search(text, max(0, at - 64), at)
            right = DOMAIN.match(text, at + 1)
            if left and right:
                spans.append((left.start(), right.end(), self.replaced("email", text[left.start() : right.end()])))
            at = text.find("@", at + 1)
        if HAS_DIGIT.search(text):
            at = 0
            while m := FOUND.search(text, at):
                at = m.start() + 1
                for start, end, new in self._at(text, m):
                    spans.append((start, end, new))
                    at = end
        if not spans:
            return text, 0
        out, done, n = [], 0, 0
        for start, end, new in sorted(spans, key=lambda s: (s[0], -s[1])):
            if start >= done:
                out += [text[done:start], new]
                done, n = end, n + 1
        out.append(text[done:])
        return "".join(out), n


#: Kinds in order of precedence at one place: what may stand before, the value, what may
#: follow. All quantifiers are bounded.
BEFORE, AFTER = r"(?<!\w)(?<!\d[.-])", r"(?![\w-])"
FINDERS = {
    "date": (BEFORE, r"(?:\d{4}-\d{1,2}-\d{1,2}|\d{4}/\d{1,2}/\d{1,2}|\d{4}\.\d{1,2}\.\d{1,2}|\d{1,2}/\d{1,2}/\d{4}|\d{1,2}\.\d{1,2}\.\d{4}|\d{1,2}-\d{1,2}-\d{4})", r"(?:(?=[Tt_]\d{2})|(?![\w/-])(?!\.\d))"),
    "ipv4": (BEFORE, r"\d{1,3}(?:\.\d{1,3}){3}", r"(?![\w-])(?!\.\d)"),
    "ssn": (BEFORE, r"\d{3}-\d{2}-\d{4}", AFTER),
    "phone": (BEFORE, r"(?:(?:\+1[ .-]?)?(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}|\+1\d{10}|\+[2-9]\d{0,2}(?:[ .-]?(?:\(\d{1,4}\)|\d{1,4})){2,6})", AFTER),
    "card": (r"(?<!\w)(?<!\d\.)", r"\d(?:[ -]?\d){12,18}", r"(?!\w)"),
    "iban": (BEFORE, r"[A-Z]{2}\d{2}(?: ?[A-Z0-9]{1,4}){3,8}", r"(?!\w)"),
    "access_key": (BEFORE, r"(?:AKIA|ASIA)[A-Z0-9]{16}", r"(?!\w)"),
}
FOUND = re.compile("|".join(f"(?P<{k}>{a}{v}{z})" for k, (a, v, z) in FINDERS.items()), re.A)
ALONE = {k: re.compile(a + v + z, re.A) for k, (a, v, z) in FINDERS.items()}
BODIES = {k: re.compile(v, re.A) for k, (_, v, _) in FINDERS.items()}
TAILS = {k: re.compile(z, re.A) for k, (_, _, z) in FINDERS.items()}
CARD_16 = re.compile(r"(?<!\w)(?:\d{16}|\d{4}([ -])\d{4}\1\d{4}\1\d{4})(?!\w)", re.A)
CARD_FORM = re.compile(r"\d{13,19}|\d{4}([ -])\d{4}\1\d{4}(?:\1\d{4})?(?:\1\d{1,3})?|\d{4}([ -])\d{6}\2\d{4,5}", re.A)
#: Lengths of the countries' account numbers, after the IBAN registry.
IBAN_LENGTHS = {
    int(x.split(":")[0]): x.split(":")[1].split()
    for x in (
        "15:NO", "16:BE", "18:DK FI FK FO GL NL SD", "19:MK SI", "20:AT BA EE KZ LT LU MN XK", "21:CH HR LI LV", "22:BG BH CR DE GB GE IE ME RS VA",
        "23:AE GI IL IQ OM SO TL", "24:AD CZ ES MD PK RO SA SE SK TN VG", "25:LY PT ST", "26:IS TR", "27:BI DJ FR GR IT MC MR SM",
        "28:AL AZ BY CY DO GT HN HU LB NI PL SV", "29:BR EG PS QA UA", "30:JO KW MU YE", "31:MT SC", "32:LC", "33:RU",
    )
}
IBANS = {c: re.compile(rf"[A-Z]{{2}}\d{{2}}(?: ?[A-Z0-9]){{{n - 4}}}(?!\w)", re.A) for n, countries in IBAN_LENGTHS.items() for c in countries}
HAS_DIGIT = re.compile("[0-9]")
HAS_SECRET = re.compile("password|passwd|token|secret|api_key", re.I)
SECRET = re.compile(r"\b(?:password|passwd|token|secret|api_key)\s{0,3}[=:]\s{0,3}[\"']?[A-Za-z0-9+/_-]{8,256}", re.I | re.A)
LOCAL = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}\Z")
DOMAIN = re.compile(r"(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}(?![A-Za-z0-9-])")


def pseudonymised(docs: DataFrame, key: bytes = PUBLIC_KEY, undo: bool = False, text: str = "text") -> DataFrame:
    """``docs`` with pseudonyms in ``text``, and ``n_pii``, how many there are."""
    keep = [c for c in docs.columns if c.lower() != "n_pii"]
    rows = docs.select(*(f"`{c}`" for c in keep))
    schema = type(rows.schema)(list(rows.schema.fields)).add("n_pii", "integer")
    place = keep.index(text)
    sized = keep.index("n_chars") if "n_chars" in keep else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = Pseudonyms(key, undo)
        for batch in batches:
            columns = list(batch.columns)
            texts = columns[place].to_pylist()
            done = [(None, 0) if t is None else names.of(t) for t in texts]
            columns[place] = pa.array([t for t, _ in done], columns[place].type)
            if sized is not None:
                columns[sized] = pa.array([n if t is None or t is old else len(t) for (t, _), old, n in zip(done, texts, columns[sized].to_pylist())], columns[sized].type)
            yield pa.RecordBatch.from_arrays([*columns, pa.array([n for _, n in done], pa.int32())], [*keep, "n_pii"])

    return rows.mapInArrow(run, schema)
