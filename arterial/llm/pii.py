"""PII: format-preserving Feistel pseudonyms.

Values are found by pattern and then validated: payment card numbers by their check
digit, dates by the calendar, addresses by the range of their parts, phone numbers by
their digit count. A valid value is permuted by a keyed Feistel network within the set
of all valid values of its format: digits stay digits, letters letters of their case,
separators stay, a card number keeps a right check digit, a date stays a date of the
same notation. The permutation depends on key, kind and format alone, so equal values
get equal pseudonyms in all documents and different values of a kind different ones,
without a table of values anywhere. A network of another size than the set is walked
until it is back in the set. Whoever has the key can turn pseudonyms back (``restore``).

Kinds, tried in this order at each place: email, secret (labelled or well-known tokens),
IBAN, IPv4, ISO and numeric date, national number (ddd-dd-dddd), card, phone. What fails
its validation is left as it is. Null text stays null, empty text empty; all other
columns pass through, whatever their names, but for n_values, which is replaced. Texts
of any length are read whole. Repeated rows give equal rows, an empty table an empty
one; where patterns of two kinds fit, the kind named first wins.
"""

import datetime
import hashlib
import hmac
import re
from collections.abc import Callable, Iterable
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .exchange import small_batches

ROUNDS = 8
DIGITS = "0123456789"
LOWER, UPPER = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
HEX_LOWER, HEX_UPPER = "0123456789abcdef", "0123456789ABCDEF"
FIRST_DAY, LAST_DAY = datetime.date(1900, 1, 1).toordinal(), datetime.date(2099, 12, 31).toordinal()

PATTERN = re.compile(
    r"""
    (?P<email>(?<![\w.%+-])[\w%+-]+(?:\.[\w%+-]+)*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,})
  | (?P<secret>(?<![A-Za-z0-9])AKIA[A-Z0-9]{16}(?![A-Za-z0-9])
      | (?:(?<=token\ =\ ["'])|(?<=TOKEN\ =\ ["'])|(?<=token=)|(?<=secret=)|(?<=api_key=)|(?<=apikey=)|(?<=password=)|(?<=PASSWORD=)|(?<=passwd=))[A-Za-z0-9_-]{8,}
      | (?<![A-Za-z0-9])[0-9a-f]{40}(?![A-Za-z0-9]) | (?<![A-Za-z0-9])[0-9A-F]{40}(?![A-Za-z0-9]))
  | (?P<iban>(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[ ]?[A-Z0-9]{4}){2,7}(?:[ ]?[A-Z0-9]{1,3})?(?![A-Za-z0-9]))
  | (?P<ip>(?<![\w.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?!\.?[0-9]|[A-Za-z_]))
  | (?P<iso>(?<![\w-])[0-9]{4}-[0-9]{2}-[0-9]{2}(?![\w-]))
  | (?P<dmy>(?<![\w./])[0-9]{2}(?P<sep>[./])[0-9]{2}(?P=sep)[0-9]{4}(?![\w/]))
  | (?P<national>(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-]))
  | (?P<card>(?<![\w-])(?:[0-9]{13,19}|[0-9]{4}(?P<gap>[ -])[0-9]{4}(?P=gap)[0-9]{4}(?P=gap)[0-9]{4}(?:(?P=gap)[0-9]{1,3})?)(?![\w-]))
  | (?P<phone>(?<![\w(])\+[0-9]{1,3}[ .-]?(?:\([0-9]{2,4}\)|[0-9]{2,4})(?:[ .-]?[0-9]{2,4}){2,4}(?!\w)
      | (?<!\w)\([0-9]{3}\)[ ]?[0-9]{3}[ .-][0-9]{4}(?!\w) | (?<![\w.-])[0-9]{3}[.-][0-9]{3}[.-][0-9]{4}(?![\w-]))
    """,
    re.VERBOSE,
)

#: Every kind holds a digit or an @, but for labelled secrets.
HINT = re.compile(r"[0-9@]|(?i:token|password|passwd|secret|api_?key)")


class Cipher:
    """A key and a direction: pseudonyms, or back to the values."""

    def __init__(self, key: bytes, back: bool = False):
        self.key, self.back = key, back

    def _network(self, number: int, half: int, tweak: str) -> int:
        mask = (1 << half) - 1
        left, right = number >> half, number & mask
        for r in reversed(range(ROUNDS)) if self.back else range(ROUNDS):
            known = left if self.back else right
            word = int.from_bytes(hashlib.blake2b(f"{tweak}|{r}|{known}".encode(), key=self.key, digest_size=32).digest(), "big") & mask
            left, right = (right ^ word, left) if self.back else (right, left ^ word)
        return left << half | right

    def permute(self, number: int, size: int, tweak: str, inside: Callable[[int], bool] = lambda n: True) -> int:
        """A keyed permutation of the numbers below size that are inside, number being one: a balanced network, walked until it lands there."""
        if size < 2:
            return number
        half = -(-(size - 1).bit_length() // 2)
        while True:
            number = self._network(number, half, f"{tweak}|{size}")
            if number < size and inside(number):
                return number


def luhn_digit(digits: str) -> str:
    """The check digit that completes these digits."""
    total = sum(d if i % 2 else d * 2 - 9 * (d > 4) for i, d in enumerate(map(int, reversed(digits))))
    return str(-total % 10)


def _refill(template: str, digits: str) -> str:
    it = iter(digits)
    return "".join(next(it) if c in DIGITS else c for c in template)


def _shape(value: str) -> str:
    return re.sub("[a-z]", "a", re.sub("[A-Z]", "A", re.sub("[0-9]", "9", value)))


def _spelled(value: str, alphabets: list[str], cipher: Cipher, tweak: str, inside: Callable[[str], bool] = lambda s: True) -> str:
    """The value as a number in mixed radix, a place a character with an alphabet, permuted among the strings that are inside."""

    def text(number: int) -> str:
        out = []
        for c, a in zip(reversed(value), reversed(alphabets), strict=True):
            if a:
                number, place = divmod(number, len(a))
                c = a[place]
            out.append(c)
        return "".join(reversed(out))

    number, size = 0, 1
    for c, a in zip(value, alphabets, strict=True):
        if a:
            number, size = number * len(a) + a.index(c), size * len(a)
    return text(cipher.permute(number, size, tweak, lambda n: inside(text(n))))


def _by_shape(value: str, cipher: Cipher, tweak: str, inside: Callable[[str], bool] = lambda s: True) -> str:
    """Each ASCII letter and digit within its class."""
    alphabets = [next((a for a in (DIGITS, LOWER, UPPER) if c in a), "") for c in value]
    return _spelled(value, alphabets, cipher, tweak + _shape(value), inside)


def _secret_class(value: str) -> str:
    """Classes of secrets that are permuted each within itself."""
    if len(value) == 20 and value.startswith("AKIA"):
        return "access key"
    if len(value) == 40 and re.fullmatch("[0-9a-f]*", value):
        return "hex"
    return "HEX" if len(value) == 40 and re.fullmatch("[0-9A-F]*", value) else "other"


def _secret(value: str, cipher: Cipher) -> str:
    kind = _secret_class(value)
    same = lambda s: _secret_class(s) == kind
    if kind in ("hex", "HEX"):
        return _spelled(value, [HEX_LOWER if kind == "hex" else HEX_UPPER] * len(value), cipher, kind, same)
    if kind == "access key":
        return value[:4] + _by_shape(value[4:], cipher, kind)
    return _by_shape(value, cipher, kind, same)


def _card(value: str, cipher: Cipher) -> str | None:
    digits = re.sub("[ -]", "", value)
    if luhn_digit(digits[:-1]) != digits[-1] or len(set(digits)) == 1:
        return None
    n = len(digits) - 1
    spelled = lambda i: (body := str(i).zfill(n)) + luhn_digit(body)
    return _refill(value, spelled(cipher.permute(int(digits[:-1]), 10**n, f"card{_shape(value)}", lambda i: len(set(spelled(i))) > 1)))


def _iban(value: str, cipher: Cipher) -> str | None:
    bare = value.replace(" ", "")
    check = lambda body: f"{98 - int(''.join(str(int(c, 36)) for c in body + bare[:2])) * 100 % 97:02d}"
    if not 15 <= len(bare) <= 34 or check(bare[4:]) != bare[2:4]:
        return None
    body = _by_shape(bare[4:], cipher, f"iban{bare[:2]}")
    it = iter(bare[:2] + check(body) + body)
    return "".join(c if c == " " else next(it) for c in value)


def _ip(value: str, cipher: Cipher) -> str | None:
    parts = value.split(".")
    if any(int(p) > 255 or (len(p) > 1 and p[0] == "0") for p in parts):
        return None
    n = cipher.permute(int.from_bytes(bytes(map(int, parts)), "big"), 1 << 32, "ip")
    return ".".join(map(str, n.to_bytes(4, "big")))


def _day(value: str, form: str) -> int | None:
    try:
        day = datetime.datetime.strptime(value, form).date().toordinal()
    except ValueError:
        return None
    return day - FIRST_DAY if FIRST_DAY <= day <= LAST_DAY else None


def _date(value: str, forms: tuple[str, ...], cipher: Cipher) -> str | None:
    """A date among those that are written in the first of the forms which fits; a later form's dates are those that fit no earlier one."""
    for k, form in enumerate(forms):
        if (day := _day(value, form)) is not None:
            written = lambda n, form=form: datetime.date.fromordinal(n + FIRST_DAY).strftime(form)
            return written(cipher.permute(day, LAST_DAY - FIRST_DAY + 1, f"date{k}", lambda n, k=k: all(_day(written(n), f) is None for f in forms[:k])))
    return None


def _phone(value: str, cipher: Cipher) -> str | None:
    digits = re.sub("[^0-9]", "", value)
    if not 7 <= len(digits) <= 15:
        return None
    country = re.match(r"\+([0-9]{1,3})(?=[ .(-])", value)
    keep = country[1] if country else ""
    rest = digits[len(keep) :]
    return _refill(value, keep + str(cipher.permute(int(rest), 10 ** len(rest), f"phone{keep}{_shape(value)}")).zfill(len(rest)))


def _national(value: str, cipher: Cipher) -> str | None:
    area, group, serial = value.split("-")
    if area in ("000", "666") or area > "899" or group == "00" or serial == "0000":
        return None
    areas = [a for a in range(1, 900) if a != 666]
    n = (areas.index(int(area)) * 99 + int(group) - 1) * 9999 + int(serial) - 1
    n, last = divmod(cipher.permute(n, len(areas) * 99 * 9999, "national"), 9999)
    first, middle = divmod(n, 99)
    return f"{areas[first]:03d}-{middle + 1:02d}-{last + 1:04d}"


def _email(value: str, cipher: Cipher) -> str:
    local, _, domain = value.rpartition("@")
    host, _, top = domain.rpartition(".")
    return f"{_by_shape(local, cipher, 'local')}@{_by_shape(host, cipher, 'host')}.{top}"


CHECKED = {"email": _email, "secret": _secret, "card": _card, "iban": _iban, "ip": _ip, "phone": _phone, "national": _national}


def pseudonym(kind: str, value: str, cipher: Cipher) -> str | None:
    """The value's pseudonym, or None if it isn't valid and has to stay."""
    if kind in CHECKED:
        return CHECKED[kind](value, cipher)
    return _date(value, ("%Y-%m-%d",) if kind == "iso" else (f"%d{value[2]}%m{value[2]}%Y", f"%m{value[2]}%d{value[2]}%Y"), cipher)


def _replacer(column: int, cipher: Cipher):
    def replace(batches: Iterable[pa.RecordBatch]):
        cached = lru_cache(maxsize=50_000)(lambda kind, value: pseudonym(kind, value, cipher))
        for batch in batches:
            texts, counts = [], []
            for text in batch.column(column).to_pylist():
                n = 0

                def swap(m: re.Match) -> str:
                    nonlocal n
                    new = cached(m.lastgroup, m[0])
                    n += new is not None
                    return m[0] if new is None else new

                texts.append(PATTERN.sub(swap, text) if text and HINT.search(text) else text)
                counts.append(n)
            columns = [pa.array(texts, pa.string()) if i == column else c for i, c in enumerate(batch.columns)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(counts, pa.int64())], [*batch.schema.names, "n_values"])

    return replace


def _replaced(df: DataFrame, key: bytes, text: str, back: bool) -> DataFrame:
    small_batches(df.sparkSession)
    df = df.drop("n_values")
    # a short key and a long one alike become 32 bytes
    cipher = Cipher(hmac.new(b"pseudonyms", key, hashlib.sha256).digest(), back)
    schema = T.StructType([*df.schema.fields, T.StructField("n_values", T.LongType())])
    return df.mapInArrow(_replacer(df.columns.index(text), cipher), schema)


def pseudonymise(df: DataFrame, key: bytes, text: str = "text") -> DataFrame:
    """df with pseudonyms in its text column, plus n_values, how many were replaced. One pass, no shuffle."""
    return _replaced(df, key, text, False)


def restore(df: DataFrame, key: bytes, text: str = "text") -> DataFrame:
    """What pseudonymise has made, turned back with its key."""
    return _replaced(df, key, text, True)
