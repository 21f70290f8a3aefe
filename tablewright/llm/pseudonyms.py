"""Format-preserving pseudonyms for personal data, by Feistel permutations.

Validated values (addresses of the net and of mail, telephone, card and insurance numbers, dates, hexadecimal
secrets) are replaced within their own format: the value's digits or characters are read as a number below the size
of the format, and a keyed Feistel network, walked until it lands below that size again, permutes those numbers. Equal
values so get equal pseudonyms in every document, different values different ones, and cards keep a valid check
digit, dates stay dates. What fails validation (a date of no calendar, a card with a wrong check digit) stays.

Digits that stand together are searched for cards from every group of digits to every other: unbroken numbers first,
then the usual layouts, then others of up to five groups, and last the longest stretch. Dates with strokes or dots are read
day first; where only month first is possible, they are permuted among the dates of which that is true too.

A null text stays null, an empty one empty. Repeated rows are treated alike. Other columns pass unchanged; the text is
replaced under its own name.
"""

from __future__ import annotations

import datetime
import hashlib
import re
import string
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.llm.batches import small_batches

ROUNDS = 8
FIRST_DAY, LAST_DAY = datetime.date(1900, 1, 1).toordinal(), datetime.date(2099, 12, 31).toordinal()

#: The forms that are looked for.
PATTERN = re.compile(
    r"(?P<email>(?<![\w.%+-])[\w.%+-]{1,64}@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}(?![\w-]))"
    r"|(?P<ip>(?<![\w.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![\w]|\.[0-9]))"
    r"|(?P<date>(?<![\w/.-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}[/.][0-9]{2}[/.][0-9]{4})(?![\w/-]|\.[0-9]))"
    r"|(?P<ssn>(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-]))"
    r"|(?P<phone>(?<![\w+])(?:\+[0-9]{1,3}[ .-]?)?\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![\w-])|(?<![\w+])\+[0-9]{8,15}(?![\w]))"
    r"|(?P<card>(?<![\w-])[0-9](?:[ -]?[0-9]){12,}(?![\w-]))"
    r"|(?P<secret>(?<![0-9A-Za-z])(?=[a-fA-F]*[0-9])(?:[0-9a-f]{32,128}|[0-9A-F]{32,128})(?![0-9A-Za-z]))"
)
#: The same without cards.
OTHERS = re.compile(re.sub(r"\|\(\?P<card>.*?(?=\|\(\?P<secret>)", "", PATTERN.pattern))
GROUP = re.compile("[0-9]+")
#: Digits of a card, the groups it may have at most, and how cards are printed in groups.
CARD_DIGITS, CARD_GROUPS = range(13, 20), 5
LAYOUTS = {(4, 4, 4, 4), (4, 6, 5), (4, 6, 4), (4, 4, 4, 1), (4, 4, 4, 3), (4, 4, 4, 4, 1), (4, 4, 4, 4, 2), (4, 4, 4, 4, 3)}
WORTH_A_LOOK = re.compile("[0-9@]")
ALPHABETS = (string.digits, string.ascii_lowercase, string.ascii_uppercase)


def permute(value: int, size: int, key: bytes, kind: str) -> int:
    """The place of ``value`` under the keyed permutation of the numbers below ``size``."""
    if size < 2:
        return value
    half = max(1, ((size - 1).bit_length() + 1) // 2)
    mask = (1 << half) - 1
    width = (half + 7) // 8
    salt = f"{kind}:{size}".encode()[:16]
    while True:
        left, right = value >> half, value & mask
        for turn in range(ROUNDS):
            mixed = hashlib.blake2b(bytes([turn]) + right.to_bytes(width, "big"), digest_size=width, key=key, salt=salt).digest()
            left, right = right, left ^ (int.from_bytes(mixed, "big") & mask)
        value = left << half | right
        if value < size:
            return value


def permute_characters(text: str, key: bytes, kind: str, places: tuple[int, ...] | None = None) -> str:
    """``text`` with its digits and letters permuted within digits, small and capital letters; others stay."""
    chars = list(text)
    spots = [i for i in (range(len(chars)) if places is None else places) if any(chars[i] in a for a in ALPHABETS)]
    alphabets = [next(a for a in ALPHABETS if chars[i] in a) for i in spots]
    value, size = 0, 1
    for i, alphabet in zip(spots, alphabets):
        value, size = value * len(alphabet) + alphabet.index(chars[i]), size * len(alphabet)
    value = permute(value, size, key, kind)
    for i, alphabet in zip(reversed(spots), reversed(alphabets)):
        value, at = divmod(value, len(alphabet))
        chars[i] = alphabet[at]
    return "".join(chars)


def _digits(text: str, key: bytes, kind: str, skip: int = 0, drop: int = 0) -> str:
    """Permute the digits but the first ``skip`` and the last ``drop``."""
    places = [i for i, c in enumerate(text) if c in string.digits]
    return permute_characters(text, key, kind, tuple(places[skip : len(places) - drop]))


def luhn_digit(digits: str) -> str:
    """The check digit that follows ``digits``."""
    total = sum(sum(divmod(int(d) * (2 - i % 2), 10)) for i, d in enumerate(reversed(digits)))
    return str(-total % 10)


def _email(text: str, key: bytes) -> str:
    keep = text.rindex(".")
    return permute_characters(text[:keep], key, "email") + text[keep:]


def _ip(text: str, key: bytes) -> str:
    parts = [int(x) for x in text.split(".")]
    if max(parts) > 255:
        return text
    value = permute(int.from_bytes(bytes(parts), "big"), 1 << 32, key, "ip")
    return ".".join(str(x) for x in value.to_bytes(4, "big"))


def _date(text: str, key: bytes) -> str:
    form = "%Y-%m-%d" if text[4] == "-" else "%d{0}%m{0}%Y".format(text[2])
    month_first = text[4] != "-" and int(text[3:5]) > 12
    if month_first:
        form = "%m{0}%d{0}%Y".format(text[2])
    try:
        day = datetime.datetime.strptime(text, form).date().toordinal()
    except ValueError:
        return text
    if not FIRST_DAY <= day <= LAST_DAY:
        return text
    while True:
        day = FIRST_DAY + permute(day - FIRST_DAY, LAST_DAY - FIRST_DAY + 1, key, "date")
        moved = datetime.date.fromordinal(day)
        if not month_first or moved.day > 12:
            return moved.strftime(form)


def _phone(text: str, key: bytes) -> str:
    country = re.match(r"\+([0-9]{1,3})[ .-]", text)
    return _digits(text, key, "phone", skip=len(country[1]) if country else 0)


def _card(text: str, key: bytes) -> str:
    digits = re.sub("[ -]", "", text)
    if luhn_digit(digits[:-1]) != digits[-1]:
        return text
    moved = _digits(text, key, "card", drop=1)
    return moved[:-1] + luhn_digit(re.sub("[ -]", "", moved)[:-1])


def _in_run(text: str, begin: int, stop: int) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the values that start in a run of groups of digits: cards, and what has another form."""
    groups = [found.span() for found in GROUP.finditer(text, begin, stop)]
    free, out = [], []
    for start, _ in groups:
        free.append(not out or start >= out[-1][1])
        if free[-1] and (other := OTHERS.match(text, start)):
            free[-1] = False
            out.append((*other.span(), other.lastgroup))
    found = []
    for i in range(len(groups)):
        n, last = 0, None
        for j in range(i, len(groups)):
            n += groups[j][1] - groups[j][0]
            if not free[j] or n > CARD_DIGITS[-1]:
                break
            if n in CARD_DIGITS:
                sizes = tuple(end - start for start, end in groups[i : j + 1])
                last = (0 if len(sizes) == 1 else 1 if sizes in LAYOUTS else 2 if len(sizes) <= CARD_GROUPS else 3, i, -n, j)
                if last[0] < 3:
                    found.append(last)
        if last and last[0] == 3 and (not i or not free[i - 1]):
            found.append(last)
    for _, i, _, j in sorted(found):
        start, end = groups[i][0], groups[j][1]
        digits = re.sub("[ -]", "", text[start:end])
        if all(free[i : j + 1]) and luhn_digit(digits[:-1]) == digits[-1]:
            free[i : j + 1] = [False] * (j + 1 - i)
            out.append((start, end, "card"))
    return sorted(out)


def _secret(text: str, key: bytes) -> str:
    alphabet = "0123456789abcdef"
    value = permute(int(text, 16), 16 ** len(text), key, "secret")
    moved = "".join(alphabet[value >> 4 * i & 15] for i in reversed(range(len(text))))
    return moved.upper() if text.isupper() else moved


KINDS = {"email": _email, "ip": _ip, "date": _date, "ssn": lambda text, key: _digits(text, key, "ssn"), "phone": _phone, "card": _card, "secret": _secret}


@lru_cache(maxsize=100_000)
def pseudonym(kind: str, text: str, key: bytes) -> str:
    return KINDS[kind](text, key)


def hide(text: str | None, key: bytes) -> tuple[str | None, int]:
    """``text`` with pseudonyms, and how many values were replaced."""
    if text is None or not WORTH_A_LOOK.search(text):
        return text, 0
    parts, n, at = [], 0, 0
    while found := PATTERN.search(text, at):
        start, stop = found.span()
        for begin, end, kind in _in_run(text, start, stop) if found.lastgroup == "card" else [(start, stop, found.lastgroup)]:
            new = pseudonym(kind, text[begin:end], key)
            n += new != text[begin:end]
            parts += text[at:begin], new
            at = end
        parts.append(text[at:stop])
        at = max(at, stop)
    parts.append(text[at:])
    return "".join(parts), n


def hidden(text: Column, key: bytes) -> Column:
    """struct(text, n_replaced)."""
    kind = pa.struct([("text", pa.string()), ("n_replaced", pa.int64())])

    @F.arrow_udf("text string, n_replaced long")
    def run(texts: pa.Array) -> pa.Array:
        found = [hide(text, key) for text in texts.to_pylist()]
        return pa.array([{"text": text, "n_replaced": n} for text, n in found], kind)

    return run(text.cast("string"))


def pseudonymise(docs: DataFrame, key: bytes, text_col: str = "text") -> DataFrame:
    """``docs`` with the values in ``text_col`` replaced; same columns, same rows."""
    small_batches(docs.sparkSession)
    return docs.withColumn(text_col, hidden(F.col(text_col), key)["text"])
