"""Personal data replaced by keyed surrogates of the same type and format.

Method. Entities are found by patterns with checks (card numbers by issuer and check digit, addresses and
account numbers by their own rules, names by a title or a known given name before them). An entity's
surrogate is a keyed permutation of the values of its format: characters keep their kind (digit, hexadecimal,
letters of a case within ASCII or within their block of 256 code points, and in secrets signs), separators and
the fixed parts of a format stay. A card keeps its issuer digit and a right check digit, an account number
its country and right check digits, an address its class (private, shared, public and so on). Known names
are exchanged within the list of their gender and script, other names keep vowels and consonants. Later and
earlier mentions of a part of a name that is found in a text get the same surrogate as there. A permutation
gives different entities different surrogates and the same entity the same one, in every text and on
every executor, without a table of entities; shifting by one place within the permutation leaves no
entity as it is. ``collisions`` checks this over a whole corpus with one shuffle of the distinct
entities, and ``checked`` stops a run whose surrogates aren't distinct.

Defined results. Null texts stay null, empty ones empty; repeated rows are all returned; an empty table
gives no rows. Texts of any length are read whole; a secret of any length is exchanged in chained parts.
Entities keep their letter case and punctuation, so a text keeps its length but for names from lists and
IPv6 addresses. Entities in a text are replaced left to right and never twice. Numbers without a right check digit
are no cards, and addresses after a word like "version" no addresses. Columns may have any names. Without
a key a fixed one is used, for tests only.
"""

from __future__ import annotations

import bisect
import functools
import hashlib
import ipaddress
import re
import unicodedata
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import column, small_batches, spread

#: The key of tests; give your own, as an argument or in the session's KEY_SETTING.
KEY = b"surrogate-key"
KEY_SETTING = "spark.surrogates.key"
ROUNDS = 6
#: Characters of a secret that are exchanged together.
PART = 48
DIGITS, LOWER, UPPER, HEX = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789abcdef"
SIGNS = "!#$%&()*+,-./:;<=>?@[]^_`{|}~\\"

#: Given names and family names by script, and given names by gender: fixed values.
MALE = {
    "latin": "James John Robert Michael William David Thomas Charles Daniel Paul Hans Peter Klaus Jean Pierre Luis Carlos Juan Pedro Antonio George Kevin Steven Edward Brian Andrew Joseph Matthew Stefan Wolfgang Jürgen Michel François José Miguel Diego Marco Giovanni Ahmed Mohammed".split(),
    "cyrillic": "Иван Пётр Сергей Алексей Дмитрий Николай Михаил Андрей Павел Олег Владимир Александр Юрий Игорь".split(),
}
FEMALE = {
    "latin": "Mary Anna Linda Susan Karen Nancy Laura Sarah Emma Julia Petra Monika Marie Sophie Claire Carmen Elena Lucia Rosa Isabel Maria Patricia Jennifer Elizabeth Barbara Jessica Margaret Emily Olivia Sabine Ursula Ingrid Isabelle Hélène Camille Pilar Teresa Francesca Fatima Aisha".split(),
    "cyrillic": "Анна Мария Елена Ольга Наталья Татьяна Ирина Светлана Юлия Дарья Екатерина Людмила Галина Вера".split(),
}
FAMILY = {
    "latin": "Smith Johnson Brown Miller Davis Wilson Moore Taylor Thomas White Schmidt Weber Fischer Wagner Becker Martin Bernard Dubois Garcia Lopez Jones Williams Anderson Clark Walker Hall Young Müller Schneider Hoffmann Leroy Moreau Laurent Fernandez Martinez Sanchez Perez Rossi Ferrari Silva".split(),
    "cyrillic": "Шевченко Коваленко Бондаренко Ткаченко Кравченко Олийник Лысенко Мельник Мороз Белых Иванов Петров Сидоров Смирнов".split(),
}
#: Titles that are followed by a name: fixed values.
TITLES = "Mr Mrs Ms Miss Dr Prof Herr Frau Señor Señora Monsieur Madame Mme Mlle господин госпожа доктор профессор".split()
#: Words before four numbers with dots that aren't an address: fixed values.
VERSIONS = ("version", "release", "build", "section", "chapter", "ver.", "ver", "v.", "v")
#: Lengths of account numbers by country: fixed values.
IBAN_LENGTHS = dict(AD=24, AE=23, AT=20, BE=16, BG=22, CH=21, CY=28, CZ=24, DE=22, DK=18, EE=20, ES=24, FI=18, FR=27, GB=22, GR=27, HR=21, HU=28, IE=22, IL=23, IS=26, IT=27, LI=21, LT=20, LU=20, LV=21, MC=27, MT=31, NL=18, NO=15, PL=28, PT=25, RO=24, RS=22, SA=24, SE=24, SI=19, SK=24, TR=26, UA=29)


def _int(key: bytes, tweak: str, *parts) -> int:
    h = hashlib.blake2b("\x1f".join([tweak, *map(str, parts)]).encode("utf-8", "surrogatepass"), key=key, digest_size=64)
    return int.from_bytes(h.digest(), "big")


def permute(value: int, size: int, key: bytes, tweak: str, back: bool = False) -> int:
    """A keyed permutation of 0 .. size - 1 (or its inverse): a Feistel network, walked until in range."""
    if size <= 1:
        return value
    half = max(1, -(-(size - 1).bit_length() // 2))
    mask = (1 << half) - 1
    wide = lambda i, x: _wide(key, tweak, i, x, half) & mask
    while True:
        left, right = value >> half, value & mask
        for i in reversed(range(ROUNDS)) if back else range(ROUNDS):
            if back:
                left, right = right ^ wide(i, left), left
            else:
                left, right = right, left ^ wide(i, right)
        value = left << half | right
        if value < size:
            return value


def _wide(key: bytes, tweak: str, i: int, x: int, bits: int) -> int:
    out = 0
    for k in range(-(-bits // 512)):
        out = out << 512 | _int(key, tweak, i, x, k)
    return out


def exchange(value: int, size: int, key: bytes, tweak: str) -> int:
    """Another value of 0 .. size - 1 (if there is one), different for different values."""
    if size <= 1:
        return value
    return permute((permute(value, size, key, tweak) + 1) % size, size, key, tweak, back=True)


def reshape(text: str, alphabets: list[str], key: bytes, tweak: str, fine: Callable[[str], bool] | None = None) -> str:
    """text with its character i exchanged within alphabets[i] ('' keeps it); repeated until fine.

    The value is the place of the characters in all strings of this shape. fine must hold for the
    text itself, so that repeating stays a permutation of the fine ones.
    """
    sizes = [len(a) for a in alphabets if a]
    value, size = 0, 1
    for c, a in zip(text, alphabets, strict=True):
        if a:
            value = value * len(a) + a.index(c)
            size *= len(a)
    shape = tweak + "".join("x" if a else c for c, a in zip(text, alphabets, strict=True)) + str(sizes)
    while True:
        value = exchange(value, size, key, shape)
        rest, out = value, []
        for c, a in zip(reversed(text), reversed(alphabets), strict=True):
            if a:
                rest, k = divmod(rest, len(a))
                out.append(a[k])
            else:
                out.append(c)
        made = "".join(reversed(out))
        if fine is None or fine(made):
            return made


@functools.lru_cache(maxsize=4096)
def alphabet(c: str, signs: bool = False) -> str:
    """The characters that c may become: of its kind, and beyond ASCII of its category and block; '' keeps it."""
    if c < "\x80":
        return next((a for a in (DIGITS, LOWER, UPPER, SIGNS if signs else "") if c in a), "")
    kind = unicodedata.category(c)
    if kind[0] not in ("LMNPS" if signs else "LMN"):
        return ""
    first = ord(c) & ~255
    # letters whose other case is one character of the block change case alike
    paired = lambda x: (len(x.lower()), len(x.upper()), x.lower().upper() == x.upper(), ord(x.lower()[0]) >> 8 == ord(x.upper()[0]) >> 8)
    return "".join(x for x in map(chr, range(max(first, 128), first + 256)) if unicodedata.category(x) == kind and paired(x) == paired(c))


def kinds(text: str, hexadecimal: bool = False, signs: bool = False) -> list[str]:
    """The alphabet of each character by its kind; '' for those that stay."""
    if hexadecimal:
        return [HEX if c in HEX else "" for c in text]
    return [alphabet(c, signs) for c in text]


def luhn(digits: str) -> bool:
    """Whether the last digit is the right check digit."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _card(text: str, key: bytes) -> str:
    digits = re.sub(r"\D", "", text)
    body = digits[0] + reshape(digits[1:-1], [DIGITS] * (len(digits) - 2), key, f"card{digits[0]}")
    body += next(c for c in DIGITS if luhn(body + c))
    rest = iter(body)
    return "".join(next(rest) if c.isdigit() else c for c in text)


def _is_card(text: str) -> bool:
    """Of an issuer's first digit, with the right check digit, and not one digit only."""
    digits = re.sub(r"\D", "", text)
    return digits[0] in "23456" and luhn(digits) and len(set(digits)) > 1


#: Classes of addresses, each kept by its surrogates: fixed values. Others are public.
_NETWORKS = [ipaddress.ip_network(x) for x in ("0.0.0.0/8", "10.0.0.0/8", "100.64.0.0/10", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12", "192.168.0.0/16", "224.0.0.0/4", "240.0.0.0/4")]
_RANGES = [(int(n.network_address), int(n.broadcast_address)) for n in _NETWORKS]


def _class_of(value: int) -> int:
    return next((i for i, (a, b) in enumerate(_RANGES) if a <= value <= b), len(_RANGES))


def _ip(text: str, key: bytes) -> str:
    value = 0
    for part in text.split("."):
        value = value << 8 | int(part)
    kind = _class_of(value)
    if kind < len(_RANGES):
        low, high = _RANGES[kind]
        value = low + exchange(value - low, high - low + 1, key, f"ip{kind}")
    else:
        value = exchange(value, 1 << 32, key, "ip")
        while _class_of(value) != kind:
            value = exchange(value, 1 << 32, key, "ip")
    return ".".join(str(value >> s & 255) for s in (24, 16, 8, 0))


def _is_ip(text: str) -> bool:
    """No loopback or unset address, which say nothing of anybody."""
    return not text.startswith("127.") and text != "0.0.0.0"


def _ip6(text: str, key: bytes) -> str:
    """The first group stays, the other 112 bits change; written without shortening."""
    value = int(ipaddress.IPv6Address(text))
    made = value >> 112 << 112 | exchange(value & (1 << 112) - 1, 1 << 112, key, f"ip6{value >> 112}")
    out = ":".join(f"{made >> s & 0xFFFF:x}" for s in range(112, -1, -16))
    return out.upper() if text.upper() == text else out


def _is_ip6(text: str) -> bool:
    try:
        value = ipaddress.IPv6Address(text)
    except ValueError:
        return False
    return (text.count(":") > 2 or bool(re.search(r"\w{3}", text))) and not value.is_loopback and not value.is_unspecified


def _remainder(iban: str) -> int:
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97


def _iban(text: str, key: bytes) -> str:
    """The country stays, the check digits are right where they were."""
    plain = text.replace(" ", "")
    right = _remainder(plain) == 1
    body = reshape(plain[4:], kinds(plain[4:]), key, f"iban{plain[:2]}" if right else f"other{plain[:4]}")
    check = f"{98 - _remainder(plain[:2] + '00' + body):02d}" if right else plain[2:4]
    if not right and _remainder(plain[:2] + check + body) == 1:
        return _iban(plain[:2] + check + body, key)
    rest = iter(plain[:2] + check + body)
    return "".join(c if c == " " else next(rest) for c in text)


def _is_iban(text: str) -> bool:
    plain = text.replace(" ", "")
    return IBAN_LENGTHS.get(plain[:2]) == len(plain) or (15 <= len(plain) <= 34 and _remainder(plain) == 1)


def _email(text: str, key: bytes) -> str:
    """The user and all labels of the domain but the last change, alike in any letter case."""
    low = text.lower() if len(text.lower()) == len(text) else text
    user, _, domain = low.rpartition("@")
    host, _, top = domain.rpartition(".")
    made = _chained(f"{user}@{host}", key, f"email.{top}") + "." + top
    return "".join(m.upper() if c.isupper() and len(m.upper()) == 1 else m for c, m in zip(text, made, strict=True))


def _phone(text: str, key: bytes) -> str:
    """The last ten digits change, alike however they are set; the country code, a leading 0 or 1 and signs stay."""
    digits = re.sub(r"\D", "", text)
    n = min(10, len(digits))
    last = digits[-n:]
    shapes = [("23456789" if c in "23456789" else "01" if i else "") if n == 10 and i in (0, 3) else DIGITS for i, c in enumerate(last)]
    made = digits[:-n] + reshape(last, shapes, key, "phone")
    rest = iter(made)
    return "".join(next(rest) if c.isdigit() else c for c in text)


def _shaped(tweak: str, keep: int = 0, hexadecimal: bool = False):
    def make(text: str, key: bytes) -> str:
        return text[:keep] + _chained(text[keep:], key, tweak + text[:keep], hexadecimal)

    return make


def _chained(text: str, key: bytes, tweak: str, hexadecimal: bool = False, signs: bool = False) -> str:
    """reshape() by parts, each permuted in a way that depends on all parts before it."""
    out, before = [], hashlib.blake2b(key=key, digest_size=16)
    for at in range(0, len(text), PART):
        part = text[at : at + PART]
        out.append(reshape(part, kinds(part, hexadecimal, signs), key, tweak + (before.hexdigest() if at else "")))
        before.update(part.encode("utf-8", "surrogatepass"))
    return "".join(out)


def _secret(text: str, key: bytes) -> str:
    """What follows the sign of a password=... or token = "..."."""
    m = re.match(r"(\w+\s*[=:]\s*[\"']?)(.*?)([\"']?)$", text, re.S)
    value = m[2]
    return m[1] + _chained(value, key, "secret", bool(re.fullmatch(r"[0-9a-f]+", value)), True) + m[3]


_VOWELS = {"latin": "aeiou", "cyrillic": "аеиоуыэюя"}
_CONSONANTS = {"latin": "bcdfghjklmnpqrstvwxyz", "cyrillic": "бвгдзклмнпрстфхцчшщ"}


def _sounds(c: str, script: str) -> str:
    """The vowels or the consonants of a letter's case and script; other letters by their block."""
    for sounds in (_VOWELS[script], _CONSONANTS[script]):
        if c in sounds:
            return sounds
        if c in sounds.upper():
            return sounds.upper()
    return alphabet(c)


def _part(name: str, lists: tuple[dict, ...], key: bytes, tweak: str) -> str:
    """A name without hyphens: exchanged within the first list that holds it, else by its sounds."""
    script = "cyrillic" if re.match(r"[Ѐ-ӿ]", name) else "latin"
    for i, known in enumerate(lists):
        if name in known[script]:
            return known[script][exchange(known[script].index(name), len(known[script]), key, f"{tweak}{i}{script}")]
    if len(name) > PART:  # no name of the lists is as long
        return "".join(reshape(p, [_sounds(c, script) for c in p], key, f"{tweak}{script}{at}") for at in range(0, len(name), PART) for p in (name[at : at + PART],))
    return reshape(name, [_sounds(c, script) for c in name], key, tweak + script, lambda x: not any(x in known[script] for known in lists))


def _name_part(name: str, given: bool, key: bytes) -> str:
    """A given or family name; the parts that hyphens set apart each on their own."""
    lists, tweak = ((MALE, FEMALE), "given") if given else ((FAMILY,), "family")
    return "-".join(_part(x, lists, key, tweak) if x else x for x in name.split("-"))


_UP, _LOW = r"[^\W\d_a-zа-яёß-öø-ÿ]", r"[^\W\d_A-ZА-ЯЁÀ-ÖØ-Þ]"
#: A capitalised name, with O' before it or more parts after a hyphen or apostrophe.
_NAME = rf"{_UP}(?:['’]{_UP})?{_LOW}+(?:[-'’]{_UP}{_LOW}+)*"
_GIVEN = tuple(n for group in (MALE, FEMALE) for names in group.values() for n in names)
_NAMES = re.compile(rf"\b(?:(?:{'|'.join(map(re.escape, TITLES))})\.?[ \t]+(?P<titled>{_NAME}(?:[ \t]+(?:{_UP}\.[ \t]+)?{_NAME}){{0,2}})|(?P<plain>(?:{'|'.join(map(re.escape, _GIVEN))})(?:[ \t]+{_UP}\.)?(?:[ \t]+{_NAME}){{1,2}}))(?![\w])")
_FIRST = frozenset((*TITLES, *_GIVEN))
_CAPITALISED = re.compile(rf"{_UP}{_LOW}+|\b(?:{'|'.join(t for t in TITLES if t[0].islower())})\b")


def _roles(text: str) -> list[tuple[int, int, bool]]:
    """(start, end, whether given) of the parts of the name in text, a title or none before it."""
    parts = [m.span() for m in re.finditer(_NAME, text)]
    if text[: parts[0][1]] in TITLES:
        parts = parts[1:]
    alone = len(parts) == 1
    return [(a, b, text[a:b] in _GIVEN if alone else i + 1 < len(parts)) for i, (a, b) in enumerate(parts)]


def _name(text: str, key: bytes) -> str:
    """A title and names, or names: given names in the list of their gender, the family name by script."""
    out, at = [], 0
    for a, b, given in _roles(text):
        out += [text[at:a], _name_part(text[a:b], given, key)]
        at = b
    return "".join([*out, text[at:]])


#: Type, pattern, check and surrogate of each kind of entity, tried in this order at each place.
PATTERNS: tuple[tuple[str, str, Callable[[str], bool] | None, Callable[[str, bytes], str]], ...] = (
    ("email", r"(?<![\w.+-])[\w.+-]+@[\w-]+(?:\.[\w-]+)*\.[^\W\d_]{2,}", None, _email),
    ("secret", r"\b(?i:password|passwd|pwd|token|secret|api_?key)\s*[=:]\s*(?:\"[^\"\s]{6,}\"|'[^'\s]{6,}'|[^\s\"']{6,})", None, _secret),
    ("cloud_key", r"\b(?:AKIA|ASIA)[A-Z0-9]{16}\b", None, _shaped("cloud", keep=4)),
    ("access_token", r"\b(?:ghp_|gho_|sk-|xoxb-|xoxp-)[A-Za-z0-9-]{16,}", None, _shaped("access", keep=3)),
    ("iban", r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b", _is_iban, _iban),
    ("ip6", r"(?<![\w:.])[0-9A-Fa-f]{0,4}(?::[0-9A-Fa-f]{0,4}){2,8}(?![\w:])", _is_ip6, _ip6),
    ("ip", r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\d]|\.\d)", _is_ip, _ip),
    ("ssn", r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])", None, _shaped("ssn")),
    ("card", r"(?<![\d-])(?:\d{13,19}|\d{4}(?:[ -]\d{4}){3}|\d{4}[ -]\d{6}[ -]\d{5})(?![\d-])", _is_card, _card),
    ("phone", r"(?<![\w+])(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)|\d{2,4})[ .-]\d{3,4}[ .-]\d{3,4}(?![\w-])|(?<![\w+])(?:\+\d{1,3}[ .-]?\d|0\d)(?:[ .-]\d{2}){4}(?![\w-])|(?<![\w+])\+\d{8,14}(?!\w)|(?<![\w+.,-])[2-9]\d{9}(?![\w-]|[.,]\d)", None, _phone),
)
_ALL = re.compile("|".join(f"(?P<{name}>{pattern})" for name, pattern, _, _ in PATTERNS))
_FITS = {name: fits for name, _, fits, _ in PATTERNS if fits}
_MAKE = {name: make for name, _, _, make in PATTERNS} | {"name": _name, "given": lambda t, key: _name_part(t, True, key), "family": lambda t, key: _name_part(t, False, key)}
#: A text without any of these has no entity but names.
_HINT = re.compile(r"[0-9@=:]")
_STARTS = ("gho_", "ghp_", "sk-", "xox", "AKIA", "ASIA")


def _versioned(text: str, at: int) -> bool:
    return text[max(0, at - 10) : at].rstrip().lower().endswith(VERSIONS) and not text[max(0, at - 10) : at].rstrip().lower()[-10:].endswith(tuple(f"{c}v" for c in LOWER))


def entities(text: str | None) -> list[tuple[str, int, int]]:
    """(type, start, end) of the entities of a text, left to right, apart; given and family are further mentions of names."""
    if not text:
        return []
    out: list[tuple[str, int, int]] = []
    if _HINT.search(text) or any(x in text for x in _STARTS):
        at = 0
        while m := _ALL.search(text, at):
            kind, at = m.lastgroup, m.end()
            if (kind in _FITS and not _FITS[kind](m[0])) or (kind == "ip" and _versioned(text, m.start())):
                continue
            out.append((kind, m.start(), m.end()))
    if _FIRST.isdisjoint(_CAPITALISED.findall(text)):
        return out
    taken = sorted((a, b) for _, a, b in out)
    parts: dict[str, str] = {}

    def apart(a: int, b: int) -> bool:
        i = bisect.bisect_left(taken, (a, a))
        return (i == len(taken) or taken[i][0] >= b) and (not i or taken[i - 1][1] <= a)

    for m in _NAMES.finditer(text):
        if apart(*m.span()):
            out.append(("name", *m.span()))
            for a, b, given in _roles(m[0]):
                parts.setdefault(m[0][a:b], "given" if given else "family")
    taken = sorted((a, b) for _, a, b in out)
    if parts:
        mentions = "|".join(map(re.escape, sorted(parts, key=len, reverse=True)))
        out += [(parts[m[0]], *m.span()) for m in re.finditer(rf"(?<![\w@])(?:{mentions})(?![\w@])", text) if apart(*m.span())]
    return sorted(out, key=lambda e: e[1])


def surrogate(kind: str, text: str, key: bytes = KEY) -> str:
    return _MAKE[kind](text, key)


def pairs(text: str, found: list[tuple[str, int, int]], key: bytes) -> Iterator[tuple[str, str, str]]:
    """(type, entity, surrogate) of what was found; names by their parts."""
    for kind, a, b in found:
        if kind == "name":
            for x, y, given in _roles(text[a:b]):
                yield "given" if given else "family", text[a + x : a + y], _name_part(text[a + x : a + y], given, key)
        else:
            yield kind, text[a:b], surrogate(kind, text[a:b], key)


def replaced(text: str | None, key: bytes = KEY) -> tuple[str | None, list[str]]:
    """The text with surrogates, and the types of the entities that it changed."""
    found = entities(text)
    if not found:
        return text, []
    out, at, changed = [], 0, []
    for kind, a, b in found:
        made = surrogate(kind, text[a:b], key)
        out += [text[at:a], made]
        at = b
        if made != text[a:b]:
            changed.append("name" if kind in ("given", "family") else kind)
    return "".join([*out, text[at:]]), changed


def key_of(spark: SparkSession) -> bytes:
    """The key in the session's KEY_SETTING; that of tests where it is unset."""
    found = spark.conf.get(KEY_SETTING, None)
    return found.encode() if found else KEY


def anonymised(docs: DataFrame, key: bytes = KEY, text_col: str = "text", count_col: str | None = "n_chars") -> DataFrame:
    """docs with surrogates in the text; count_col, where there is one, follows texts that change length."""
    small_batches(docs.sparkSession)
    at = docs.columns.index(text_col)
    counted = docs.columns.index(count_col) if count_col in docs.columns and isinstance(docs.schema[count_col].dataType, (T.LongType, T.IntegerType)) else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at).to_pylist()
            made = [replaced(t, key)[0] for t in texts]
            columns = list(batch.columns)
            columns[at] = pa.array(made, columns[at].type)
            if counted is not None:
                counts = columns[counted].to_pylist()
                counts = [len(m) if m is not None and len(m) != len(t) else c for t, m, c in zip(texts, made, counts, strict=True)]
                columns[counted] = pa.array(counts, columns[counted].type)
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

    return docs.mapInArrow(run, docs.schema)


def reported(docs: DataFrame, key: bytes = KEY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text (with surrogates), n_entities and kinds (sorted distinct types) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [replaced(t, key) for t in batch.column("text").to_pylist()]
            columns = [batch.column("doc_id"), pa.array([t for t, _ in made], pa.string()), pa.array([len(k) for _, k in made], pa.int64()), pa.array([sorted(set(k)) for _, k in made], pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text", "n_entities", "kinds"])

    small_batches(docs.sparkSession)
    source = docs.select(column(docs, id_col).cast("long").alias("doc_id"), column(docs, text_col).cast("string").alias("text"))
    return spread(source).mapInArrow(run, "doc_id long, text string, n_entities long, kinds array<string>")


def plain_form(kind: str, entity: str) -> str:
    """An entity without what is only its setting: letter case, and the zeros of an address."""
    if kind == "ip":
        return ".".join(str(int(x)) for x in entity.split("."))
    return str(ipaddress.IPv6Address(entity)) if kind == "ip6" else entity.lower()


def collisions(docs: DataFrame, key: bytes = KEY, text_col: str = "text") -> DataFrame:
    """(kind, surrogate, n) of surrogates that stand for more than one entity; empty if all is well.

    Entities that differ only in case or setting count as one, as they are meant to. One shuffle of
    distinct entities, none of which leaves the executors.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = {(k, plain_form(k, e), m.lower()) for t in batch.column(0).to_pylist() if t for k, e, m in pairs(t, entities(t), key)}
            columns = list(zip(*sorted(rows), strict=True)) or [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns], ["kind", "entity", "surrogate"])

    small_batches(docs.sparkSession)
    found = spread(docs.select(column(docs, text_col).cast("string").alias("text"))).mapInArrow(run, "kind string, entity string, surrogate string").distinct()
    return found.groupBy("kind", "surrogate").agg(F.count("*").alias("n")).where("n > 1")


def checked(docs: DataFrame, key: bytes = KEY, text_col: str = "text") -> DataFrame:
    """docs, once no two entities of theirs have the same surrogate; else an error."""
    if not collisions(docs, key, text_col).isEmpty():
        raise ValueError("two entities have the same surrogate: take another key")
    return docs
