"""Replacing personal data by keyed surrogates.

Entities are found in whole texts. Every different entity gets a surrogate of its own type, drawn by a keyed hash: digits for
digits and letters for letters in the same places, check digits that hold, names of the same gender and script. Surrogates
that two entities drew, or that is an entity of the corpus itself, are drawn again, so different entities stay different;
the same entity has the same surrogate wherever it occurs, also a surname that is mentioned again on its own.
"""

from __future__ import annotations

import hashlib
import hmac
import ipaddress
import re
from collections.abc import Callable
from contextlib import suppress
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkweft.llm.columns import column, others, packed, unpacked
from sparkweft.staging import stage

MOST_DRAWS = 64

# Forms of address with the gender of the name that follows, '' where they don't tell.
TITLES = {
    "Mr": "m", "Mrs": "f", "Ms": "f", "Miss": "f", "Dr": "", "Prof": "", "Herr": "m", "Herrn": "m", "Frau": "f",
    "Monsieur": "m", "Madame": "f", "Mme": "f", "Mlle": "f", "Señor": "m", "Señora": "f", "Sr": "m", "Sra": "f",
    "Господин": "m", "Госпожа": "f", "Κύριος": "m", "Κυρία": "f",
}
# Given names by script and gender, and syllables for surnames by script.
GIVEN = {
    ("latin", "m"): "Adam Bruno Carl David Emil Felix Hugo Jonas Leon Martin Oscar Paul Robert Simon Thomas Victor".split(),
    ("latin", "f"): "Alice Berta Clara Diana Elena Flora Helena Irene Julia Laura Maria Nina Olga Paula Sofia Vera".split(),
    ("latin", ""): "Alex Andrea Chris Dominique Jo Kim Lou Maxime Nicola Pat Robin Sam Sascha Terry Toni Val".split(),
    ("cyrillic", "m"): "Антон Борис Виктор Глеб Денис Егор Иван Кирилл Лев Максим Олег Павел Роман Степан".split(),
    ("cyrillic", "f"): "Алла Вера Галина Дарья Елена Жанна Инна Ксения Лидия Мария Нина Ольга Полина Софья".split(),
    ("cyrillic", ""): "Валя Женя Саша Шура Паша Слава".split(),
    ("greek", "m"): "Ανδρέας Γιώργος Δημήτρης Κώστας Νίκος Πέτρος Σπύρος Χρήστος".split(),
    ("greek", "f"): "Άννα Βασιλική Ελένη Ιωάννα Μαρία Νίκη Σοφία Χριστίνα".split(),
    ("greek", ""): "Αλέξης Άγγελος Χαρά Φώτης".split(),
}
# Given names that tell a person without a form of address, if a capital name follows.
KNOWN_GIVEN = {
    "m": (
        "Adam Alan Albert Alexander Andreas Andrew Anthony Antonio Arthur Benjamin Bernard Brian Bruno Carlos Charles Christian "
        "Christopher Daniel David Edward Emil Eric Felix Fernando Francesco Frank George Giovanni Gustav Hans Harold Heinrich "
        "Henry Hugo Jacques Jakob James Javier Jean Jonas Joseph Juan Julien Kevin Klaus Leon Louis Lukas Marcel Marek Mario "
        "Martin Matthew Michael Miguel Nicolas Oscar Patrick Pedro Peter Philippe Pierre Piotr Richard Robert Simon Stefan Steven "
        "Thomas Timothy Vincent Walter William Wolfgang John Paul"
    ).split(),
    "f": (
        "Alice Amanda Andrea Angela Anna Barbara Beatrice Bertha Carla Carmen Caroline Catherine Charlotte Christine Clara Claire "
        "Daniela Deborah Diana Dorothy Elena Elisabeth Elizabeth Emily Emma Flora Florence Gabriela Hannah Heidi Helen Helena Ingrid "
        "Irene Isabel Jennifer Jessica Joanna Julia Karen Katarzyna Laura Linda Louise Lucia Margaret Maria Marie Martha Mary Monika "
        "Nancy Natalie Olga Patricia Paula Rachel Rebecca Rosa Ruth Sandra Sarah Silvia Sofia Sophie Susan Teresa Ursula Valentina Vera"
    ).split(),
}
# Words between the names of a person.
PARTICLES = "al bin da de del della den der di do dos du la le ten ter van von zu".split()
# Frequent Chinese surnames, characters of given names, and forms of address that follow a name.
HAN_SURNAMES = "王李张刘陈杨黄赵吴周徐孙马朱胡郭何高林罗郑梁谢宋唐许韩冯邓曹彭曾肖田董袁潘于蒋蔡余杜叶程苏魏吕丁任沈姚卢姜崔钟谭陆汪范金石廖贾夏韦方白邹孟熊秦邱江尹薛"
HAN_GIVEN = "安博晨丹东芳峰刚光国海浩华佳建杰静军俊兰磊丽亮敏明娜宁平强青荣瑞珊涛婷伟文霞祥晓欣雪燕怡英勇玉云泽志"
HAN_TITLES = {"先生": "m", "女士": "f", "小姐": "f"}
# Calling codes of one and two digits; all others have three.
SHORT_CODES = frozenset(
    "1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split()
)
SYLLABLES = {
    "latin": "ba ber den dor fal gan hol kel lan mar nor pel ros sel tan ver wil zan".split(),
    "cyrillic": "ба вер гор дан жел зор кол лан мар нев пол рос сел тав".split(),
    "greek": "βα γορ δαν ζελ καλ λαν μαρ νευ πολ ροδ σελ ταν".split(),
}

_HOST = r"[A-Za-z0-9\u00C0-\u024F\u0370-\u052F-]+"  # other scripts stand without blanks beside an address
_EMAIL = rf"(?P<email>[\w.%+-]+@{_HOST}(?:\.{_HOST})+)"
_SECRET = (
    r"(?P<pem>-----BEGIN [A-Z ]*PRIVATE KEY-----[\s\S]*?-----END [A-Z ]*PRIVATE KEY-----)"
    r"|(?P<prefixed>(?<![A-Za-z0-9])(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|sk-[A-Za-z0-9]{20,}|xox[abp]-[A-Za-z0-9-]{10,}"
    r"|eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}))"
    r"|(?:(?:[pP]assw(?:or)?d|PASSW(?:OR)?D)[\"']?\s{0,3}[=:]\s{0,3}[\"']?(?P<password>[A-Za-z0-9_+/.\-!@#$%^&*]{8,}))"
    r"|(?:(?:[tT]oken|TOKEN|[sS]ecret|SECRET|[pP]assw(?:or)?d|PASSW(?:OR)?D|[kK]ey|KEY)[\"']?\s{0,3}[=:]\s{0,3}[\"']?"
    r"(?P<secret>(?=[A-Za-z_+/.\-]*[0-9])[A-Za-z0-9_+/.\-]{8,}={0,2}))"
)
_NUMBER_KINDS = (
    r"(?P<iban>(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9]))",
    r"(?P<ipv6>(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])"
    r"|(?<![\w:.])(?:[0-9A-Fa-f]{1,4}:){1,6}:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,5}(?![\w:]))",
    r"(?P<ip>(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9]|\.[0-9]))",
    r"(?P<ssn>(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-]))",
    r"(?P<card>(?<![0-9])[0-9](?:[ -]?[0-9]){12,18}(?![0-9]))",
    r"(?P<phone>(?<![0-9+])\+1[ .-]?(?:\([0-9]{3}\)|[0-9]{3})[ .-]?[0-9]{3}[ .-]?[0-9]{4}(?![0-9])"
    r"|(?<![0-9+])\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)|[0-9]{1,4})(?:[ -]?[0-9]{2,4}){2,4}(?![0-9]|\.[0-9])"
    r"|(?<![0-9(])\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4}(?![0-9])|(?<![0-9-])[0-9]{3}[-.][0-9]{3}[-.][0-9]{4}(?![0-9-])"
    r"|(?<![0-9+.,:/-])0[1-9][0-9]{1,3}[ /-][0-9]{5,8}(?![0-9]|[.,:/-][0-9])"
    r"|(?<=[\u4e00-\u9fff：: ])1[3-9][0-9]{9}(?=[\u4e00-\u9fff，。；、]|\s*$))",
)
_NUMBERS = "|".join(_NUMBER_KINDS)


def _ranges(test: Callable[[str], bool]) -> str:
    """Characters of the scripts with case that pass a test, as the inside of a character class."""
    codes = [code for code in range(0x41, 0x2E00) if test(chr(code))]
    firsts = [code for code in codes if not test(chr(code - 1))]
    lasts = [code for code in codes if not test(chr(code + 1))]
    return "".join(f"\\u{first:04x}-\\u{last:04x}" for first, last in zip(firsts, lasts, strict=True))


_LETTER, _UPPER = r"[^\W\d_]", f"[{_ranges(str.isupper)}]"
_NAME = rf"{_UPPER}(?:{_LETTER}|['’](?!s(?!\w))(?={_LETTER}))+"  # also McDonald and O'Brien; a final 's stays outside
_BETWEEN = rf"(?:{_UPPER}\. ?|(?:{'|'.join(PARTICLES)}) ){{0,3}}"  # initials and particles
_PERSON = (
    rf"(?P<person>(?<!\w)(?:{'|'.join(TITLES)})\.? {_BETWEEN}{_NAME}(?:[ -]{_BETWEEN}{_NAME}){{0,2}}(?!\w))"
    rf"|(?P<named>(?<!\w)(?:{'|'.join(KNOWN_GIVEN['m'] + KNOWN_GIVEN['f'])}) {_BETWEEN}{_UPPER}{_LETTER}*[^\W\d_A-Z]{_LETTER}*(?!\w))"
    rf"|(?P<han>[{HAN_SURNAMES}][\u4e00-\u9fff]{{0,2}}?)(?={'|'.join(HAN_TITLES)})"
)
_FIND = re.compile("|".join((_EMAIL, _SECRET, _NUMBERS, _PERSON)), re.UNICODE)
_CHECKED = {re.match(r"\(\?P<(\w+)>", each).group(1): re.compile(each) for each in _NUMBER_KINDS}  # whose matches may be none

# Groupings in which cards of 16, 15 and 14 digits are written.
_USUAL_CARD = re.compile(r"(?:[0-9]{13,19}|[0-9]{4}(?:[ -][0-9]{4}){3}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{4,5})(?![0-9])")

# Parts of the words that stand before a secret, and beginnings of secrets.
_SIGNS = ("oken", "ecret", "assw", "key", "Key", "AKIA", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "sk-", "xox", "BEGIN", "eyJ", *HAN_TITLES)
_TITLE = (
    r"[DFHMPSГΚ](?:rs?|s|iss|rof|errn?|rau|onsieur|adame|me|lle|eñora?|ra|осподин|оспожа|ύριος|υρία)\.? (?:\p{Lu}|\p{Ll}{2,5} )"
)


def _known_given() -> str:
    """A pattern for known given names before another word, by first letter."""
    by_first: dict[str, list[str]] = {}
    for name in KNOWN_GIVEN["m"] + KNOWN_GIVEN["f"]:
        by_first.setdefault(name[0], []).append(name[1:])
    return "(?=[A-Z])(?<![A-Za-z])(?:" + "|".join(f"{first}(?:{'|'.join(rest)})" for first, rest in sorted(by_first.items())) + r") \p{L}"


def may_hold(text: Column) -> Column:
    """Whether a text can hold an entity at all, by searches that are far cheaper than those for entities. Whatever these
    find lets the text pass; every entity has one of them."""
    signs = [text.contains(sign) for low in _SIGNS for sign in dict.fromkeys((low, low.upper()))]
    found = text.contains("@")
    for sign in signs:
        found = found | sign
    digits = text.rlike(r"[0-9][0-9 ().\-]{5,}[0-9]") | text.rlike("[A-Z][0-9][0-9]")
    numbers = digits | (text.contains(":") & text.rlike("[0-9A-Fa-f]:(?:[0-9A-Fa-f]{1,4}:|:[0-9A-Fa-f])"))
    return F.coalesce(found | numbers | text.rlike(_TITLE) | text.rlike(_known_given()), F.lit(False))


class Entity(NamedTuple):
    first: int
    last: int
    kind: str
    value: str  # the same for all ways to write the entity


def luhn(digits: str) -> bool:
    total = 0
    for place, digit in enumerate(reversed(digits)):
        doubled = int(digit) * (1 + place % 2)
        total += doubled - 9 * (doubled > 9)
    return total % 10 == 0


def _iban_holds(value: str) -> bool:
    moved = value[4:] + value[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def _digits(value: str) -> str:
    return re.sub("[^0-9]", "", value)


def _script(name: str) -> str:
    code = ord(name[0])
    if 0x4E00 <= code < 0xA000:
        return "han"
    return "cyrillic" if 0x400 <= code < 0x530 else "greek" if 0x370 <= code < 0x400 or 0x1F00 <= code < 0x2000 else "latin"


def _people(names: str, gender: str, at: int) -> list[Entity]:
    """The names of one person in a text from ``at``; the last word is the surname, in all its parts joined by hyphens. Initials and
    particles are left as they are."""
    words = [(m.start(), m.group()) for m in re.finditer(r"[^ ]+", names)]
    words = [(start, word) for start, word in words if word not in PARTICLES]
    entities = []
    for number, (start, word) in enumerate(words):
        kind = "surname" if number == len(words) - 1 else f"given_{gender}" if gender else "given"
        for part in re.finditer(r"[^.-]+(?![^-]*\.)", word):
            entities.append(Entity(at + start + part.start(), at + start + part.end(), kind, part.group()))
    return entities


def _named(kind: str, written: str, at: int) -> list[Entity]:
    """The names in a match of a person, found by a form of address before or behind, or by a known given name."""
    if kind == "han":
        return [Entity(at, at + len(written), "surname", written)]
    if kind == "person":
        title, names = written.split(" ", 1)
        return _people(names, TITLES[title.rstrip(".")], at + len(title) + 1)
    return _people(written, "m" if written.split(" ", 1)[0] in KNOWN_GIVEN["m"] else "f", at)


def _ipv6_holds(written: str) -> bool:
    with suppress(ValueError):
        return any(c.isdigit() for c in written) and ipaddress.IPv6Address(written) is not None
    return False


def _card_length(written: str, text: str, first: int) -> int:
    """Characters at the beginning that are a card, 0 if none are: the whole, else up to the end of a group of digits. Usual
    groupings and lengths come first, also one that begins at a later group, then the longest."""
    groups = list(re.finditer("[0-9]+", written))
    ends = [m.end() for m in groups if 13 <= len(_digits(written[: m.end()])) <= 19 and luhn(_digits(written[: m.end()]))]
    usual = [end for end in ends if _USUAL_CARD.fullmatch(written[:end])]
    if usual or not ends:
        return max(usual, default=0)
    later = [_USUAL_CARD.match(text, first + m.start()) for m in groups[1:] if m.start() < max(ends)]
    return 0 if any(m and luhn(_digits(m.group())) for m in later) else max(ends)


def _iban_length(written: str) -> int:
    """Characters at the beginning that are an IBAN, 0 if none are: the whole, else up to a blank, the longest first."""
    ends = [len(written), *(m.start() for m in re.finditer(" ", written))]
    values = {end: written[:end].replace(" ", "") for end in ends}
    return max((end for end, value in values.items() if 15 <= len(value) <= 34 and _iban_holds(value)), default=0)


def _checked(kind: str, written: str, text: str, first: int) -> tuple[int, str]:
    """Characters at the beginning of a match in ``text`` that are an entity of the kind, 0 if none are, and its value."""
    if kind == "email":
        return len(written), written.lower()
    if kind == "ip":
        return len(written) * all(int(part) <= 255 for part in written.split(".")), written
    if kind == "iban":
        length = _iban_length(written)
        return length, written[:length].replace(" ", "")
    if kind == "card":
        length = _card_length(written, text, first)
        return length, _digits(written[:length])
    if kind == "phone":
        return len(written) * (8 <= len(_digits(written)) <= 15), "+" * written.startswith("+") + _digits(written)
    if kind == "ipv6":
        return len(written) * _ipv6_holds(written), written
    return len(written), _digits(written) if kind == "ssn" else written


def find_entities(text: str | None) -> list[Entity]:
    """Entities of a whole text in order, none overlapping another. Behind the beginning of a match that fails its check the
    search goes on, so such a match hides nothing that overlaps it."""
    if not text:
        return []
    found: list[Entity] = []
    at = 0
    while m := _FIND.search(text, at):
        kind = next(k for k, v in m.groupdict().items() if v is not None)
        first, last = m.start(kind), m.end(kind)
        at = m.end()
        if kind in ("person", "named", "han"):
            found += _named(kind, m.group(kind), first)
            continue
        length, value = _checked(kind, m.group(kind), text, first)
        if not length and kind in _CHECKED:  # another kind may begin at the same place
            for kind, pattern in _CHECKED.items():
                other = pattern.match(text, first)
                length, value = _checked(kind, other.group(), text, first) if other else (0, "")
                if length:
                    break
            at = first + max(length, 1)
        elif kind in _CHECKED:
            at = first + length
        if length:
            found.append(Entity(first, first + length, "secret" if kind in ("pem", "prefixed", "password") else kind, value))
    names = {e.value: e.kind for e in found if e.kind == "surname" or e.kind.startswith("given")}
    if names:  # the same names, mentioned without a form of address
        again = re.compile(r"(?<!\w)(?:" + "|".join(sorted(map(re.escape, names), reverse=True)) + r")(?!\w)")
        taken = sorted((e.first, e.last) for e in found)
        at = 0
        for m in again.finditer(text):
            while at < len(taken) and taken[at][1] <= m.start():
                at += 1
            if at == len(taken) or taken[at][0] >= m.end():
                found.append(Entity(m.start(), m.end(), names[m.group()], m.group()))
        found.sort()
    return found


class _Draw:
    """Numbers from a keyed hash of an entity and the count of draws so far."""

    def __init__(self, key: bytes, kind: str, value: str, attempt: int):
        self.key, self.seed = key, f"{kind}\0{value}\0{attempt}".encode("utf-8", "surrogatepass")
        self.block, self.left = 0, b""

    def below(self, bound: int) -> int:
        if len(self.left) < 4:
            self.left = hmac.digest(self.key, self.seed + self.block.to_bytes(4, "big"), hashlib.sha256)
            self.block += 1
        number, self.left = int.from_bytes(self.left[:4], "big"), self.left[4:]
        return number % bound

    def like(self, char: str, hexadecimal: bool = False) -> str:
        """A character of the same kind."""
        if char.isascii():
            if char.isdigit():
                return "0123456789"[self.below(10)]
            if char.isalpha():
                letters = "abcdef" if hexadecimal else "abcdefghijklmnopqrstuvwxyz"
                drawn = letters[self.below(len(letters))]
                return drawn.upper() if char.isupper() else drawn
            return char
        if char.isalpha():
            letters = "".join(SYLLABLES[_script(char)])
            drawn = letters[self.below(len(letters))]
            return drawn.upper() if char.isupper() else drawn
        return char


def surrogate(kind: str, value: str, attempt: int, key: bytes) -> str:
    """The ``attempt``-th surrogate of an entity. Late attempts are wider, so that short entities don't run out of others."""
    draw = _Draw(key, kind, value, attempt)
    wider = attempt // 16
    if kind == "email":
        local, domain = value.rsplit("@", 1)
        host, _, top = domain.rpartition(".")
        return "".join(map(draw.like, local + "x" * wider)) + "@" + "".join(map(draw.like, host)) + "." + top
    if kind == "ip":
        return ".".join(str(1 + draw.below(254)) for _ in range(4))
    if kind == "card":
        body = value[0] + "".join(map(draw.like, value[1:-1] + "0" * wider))
        return next(body + d for d in "0123456789" if luhn(body + d))
    if kind == "phone":
        start = next((n for n in (2, 3) if value[1:n] in SHORT_CODES), 4) if value.startswith("+") else 1
        return value[:start] + "".join(map(draw.like, value[start:] + "0" * wider))
    if kind == "iban":
        body = "".join(map(draw.like, value[4:]))
        rest = int("".join(str(int(c, 36)) for c in body + value[:2] + "00")) % 97
        return f"{value[:2]}{98 - rest:02d}{body}"
    if kind == "surname" or kind.startswith("given"):
        script = _script(value)
        if script == "han":
            given = "".join(HAN_GIVEN[draw.below(len(HAN_GIVEN))] for _ in range(len(value) - 1 + attempt // 4))
            return HAN_SURNAMES[draw.below(len(HAN_SURNAMES))] + given
        if kind == "surname":
            syllables = SYLLABLES[script]
            return "".join(syllables[draw.below(len(syllables))] for _ in range(3 + attempt // 4)).capitalize()
        names = GIVEN[script, kind.partition("_")[2]]
        return "-".join(names[draw.below(len(names))] for _ in range(1 + (attempt + 1) // 2))
    hexadecimal = kind == "ipv6" or re.fullmatch("[0-9a-f]+|[0-9A-F]+", value) is not None
    if value.startswith("-----BEGIN"):
        head, body, foot = re.fullmatch(r"(-----BEGIN[^\n]*?-----)([\s\S]*)(-----END.*)", value).groups()
        return head + "".join(map(draw.like, body)) + foot
    fixed = re.match(r"AKIA|gh[pousr]_|sk-|xox[abp]-|eyJ", value)
    start = fixed.end() if fixed else 0
    more = "" if kind == "ipv6" else ("0" if kind == "ssn" else "x") * wider
    return value[:start] + "".join(draw.like(c, hexadecimal) for c in value[start:] + more)


def written_like(kind: str, written: str, new: str) -> str:
    """The surrogate in the form in which the entity was written."""
    if kind in ("card", "phone", "ssn"):
        digits = iter(_digits(new))
        return "".join(next(digits) if c.isascii() and c.isdigit() else c for c in written) + "".join(digits)
    if kind == "iban" and " " in written:
        chars = iter(new)
        return "".join(c if c == " " else next(chars) for c in written)
    if kind == "email" and written.isupper():
        return new.upper()
    return new


def replace_entities(text: str | None, new: dict[tuple[str, str], str]) -> tuple[str | None, list[tuple[str, int, int]]]:
    """The text with surrogates, and kind, first and last place of each in the new text."""
    parts, spans, at, length = [], [], 0, 0
    for e in find_entities(text):
        inner = written_like(e.kind, text[e.first : e.last], new[e.kind, e.value])
        parts += [text[at : e.first], inner]
        length += e.first - at
        spans.append((e.kind, length, length + len(inner)))
        length += len(inner)
        at = e.last
    return (text if not parts else "".join(parts) + text[at:]), spans


def _entities_column(text: Column) -> Column:
    kind = pa.list_(pa.struct([("kind", pa.string()), ("value", pa.string())]))

    @F.arrow_udf("array<struct<kind:string,value:string>>")
    def find(texts: pa.Array) -> pa.Array:
        rows = []
        for text in texts:
            pairs = {(e.kind, e.value) for e in find_entities(text.as_py())}
            rows.append([{"kind": a, "value": b} for a, b in sorted(pairs)])
        return pa.array(rows, kind)

    return find.asNondeterministic()(text)


def assign_surrogates(entities: DataFrame, key: bytes) -> DataFrame:
    """``kind``, ``value`` and ``new`` for the distinct entities (kind, value), no two of a kind with the same ``new`` and none
    that is an entity itself. Each round settles the surrogates that nobody else has, and draws the others again."""

    @F.arrow_udf("string")
    def draw(kinds: pa.Array, values: pa.Array, attempts: pa.Array) -> pa.Array:
        rows = zip(kinds.to_pylist(), values.to_pylist(), attempts.to_pylist(), strict=True)
        return pa.array([surrogate(a, b, c, key) for a, b, c in rows], pa.string())

    known = stage(entities.select("kind", "value").distinct())
    taken = known.select("kind", F.col("value").alias("new"))  # no surrogate may be one of these
    pending, settled = known, None
    for attempt in range(MOST_DRAWS):
        drawn = stage(pending.withColumn("new", draw.asNondeterministic()("kind", "value", F.lit(attempt))))
        firsts = drawn.groupBy("kind", "new").agg(F.min("value").alias("value")).join(taken, ["kind", "new"], "left_anti")
        won = stage(firsts.select("kind", "value", "new"))
        settled = won if settled is None else settled.unionByName(won)
        pending = stage(drawn.select("kind", "value").join(won, ["kind", "value"], "left_anti"))
        if pending.isEmpty():
            return settled
        taken = taken.unionByName(won.select("kind", "new"))
    raise ValueError(f"entities are left without a surrogate of their own after {MOST_DRAWS} draws")


def pseudonymize(df: DataFrame, key: bytes, text: str = "text") -> DataFrame:
    """Every row with its text replaced, ``n_entities`` (int) and ``entities`` (kind, first, last in the new text).

    Null texts stay null with no entity; empty ones and those without entities stay as they are. Texts are searched whole. Equal
    texts get equal results, and an entity the same surrogate in all rows; the key alone decides it, but for draws that meet.
    Only texts that may hold an entity are shuffled, to meet their surrogates by a hash of the text; a large group of copies
    is one row on the other side of that join. No rows give no rows. Columns named like the results are replaced.
    """
    names = others(df, "n_entities", "entities")
    spans = "array<struct<kind:string,first:int,last:int>>"
    marked = df.select(packed(df), column(text).alias("text"))
    marked = marked.withColumn("may", may_hold(F.col("text")))
    hashed = F.xxhash64("text")
    held = marked.where("may").select(hashed.alias("hash"), _entities_column(F.col("text")).alias("found"))
    pairs = stage(held.select("hash", F.inline("found")).distinct())
    surrogates = assign_surrogates(pairs.select("kind", "value"), key)
    each = stage(pairs.join(surrogates, ["kind", "value"]).groupBy("hash").agg(F.collect_list(F.struct("kind", "value", "new")).alias("new")))

    @F.arrow_udf(f"struct<text:string,entities:{spans}>")
    def replace(texts: pa.Array, news: pa.Array) -> pa.Array:
        rows = []
        for text, new in zip(texts, news, strict=True):
            table = {(r["kind"], r["value"]): r["new"] for r in new.as_py() or ()}
            done, found = replace_entities(text.as_py(), table) if table else (text.as_py(), [])
            rows.append({"text": done, "entities": [{"kind": a, "first": b, "last": c} for a, b, c in found]})
        span = pa.struct([("kind", pa.string()), ("first", pa.int32()), ("last", pa.int32())])
        return pa.array(rows, pa.struct([("text", pa.string()), ("entities", pa.list_(span))]))

    def result(done: Column, entities: Column) -> list[Column]:
        kept = [done.alias(n) if n == text else F.col("row").getField(n).alias(n) for n in names]
        return [*kept, F.size(entities).alias("n_entities"), entities.alias("entities")]

    free = marked.where("not may").select(*result(F.col("text"), F.array().cast(spans)))
    met = marked.where("may").withColumn("hash", hashed).join(each, "hash", "left")
    done = met.select("row", replace.asNondeterministic()("text", "new").alias("done"))
    return free.unionByName(done.select(*result(F.col("done.text"), F.col("done.entities"))))
