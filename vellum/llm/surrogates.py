"""Personal data: detected entities get keyed surrogates of the same type, gender, script and format.

A surrogate is made by a keyed permutation of all values of the entity's format, so it needs no table of
the corpus and no shuffle: within a format different entities get different surrogates (distinctness), and
an entity gets the same one in every document, in whatever case or punctuation it is written, a phone number with its
country code or its trunk zero (coreference). The permutation P is a Feistel network over the numbers of the
format's values; the surrogate of x is P^-1(P(x) + 1), which is never x itself. Two entities of a document can meet only where
letters have no alphabet here or a title overrules a list; the later one then walks on along the cycle until it is alone (Book), so in
such a document it differs from its surrogate in others. The key is the caller's: who has it
can undo the replacement, so it belongs beside no output, and there is none in this file.

Formats: letters stay letters of their script and case, digits digits, all else stays. In names vowels
stay vowels; given names on the lists are replaced from the list of the title's gender, or else of their own, others by letters
and never by a listed name; the letter before an apostrophe (O'Neill) stays. Card numbers keep their check digit right, phone numbers their country code,
addresses of the internet stay dotted quads, secrets keep their alphabet, dates of birth become days of their own
notation. check() states the collision checks that every document's replacements pass.

What is found: mail and internet addresses, phone, card (of a known issuer's range, with a right check digit), bank account and
social security numbers, secrets (by their own form, or behind a word like `password=`), postal addresses with a street's
word, dates behind a word like `born`. A person is found by a title or a listed given name in front of a capitalised name, or as
two capitalised names that a mail address of the document is made of; the names so found are replaced wherever else
the document has them, before or after, alone or in a row. A person whom a document names only otherwise is not found.

Every pattern reads a stretch of text a bounded number of times, so time follows the text's length.
"""

from __future__ import annotations

import datetime
import hashlib
import math
import re
import secrets
import unicodedata
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from vellum.llm.common import column, spread

ROUNDS = 6
#: Steps along a cycle that an entity takes at most to be alone.
WALK = 1_000

# Titles by gender and given names by gender.
TITLES_F = ("Mrs", "Ms", "Miss", "Madam", "Frau", "Mme", "Madame", "Mlle", "Sra", "Señora", "Doña")
TITLES_M = ("Mr", "Sir", "Herr", "Monsieur", "Sr", "Señor", "Don")
TITLES_N = ("Dr", "Prof")
GIVEN_F = tuple(
    "Agnes Alice Amelia Andrea Angela Anna Beatrice Bertha Brigitte Camille Carla Carmen Catherine Charlotte Christine Clara Claudia Dolores Dorothea Eleanor Elena Elisabeth Elizabeth Emily Emma Esther Florence Gabriela Gertrud Greta Hannah Harriet Helena Ingrid Isabel Jane Johanna Josefina Juana Julia Katharina Laura Lucia Madeleine Margaret Maria Mary Mathilde Monika Nora Olga Paula Rachel Rebecca Renate Rosa Ruth Sarah Sofia Sophie Susanna Teresa Ursula Victoria Yvonne".split()
)
GIVEN_M = tuple(
    "Albert Alfonso Andrew Anthony Anton Arthur Benjamin Bernard Bruno Carlos Charles Christian Daniel David Diego Dieter Edward Emilio Enrique Ernst Felix Fernando Francis Frank Friedrich Georg George Gerhard Hans Heinrich Henry Hugo Jakob James Javier Jean Johann John Joseph Juan Karl Kurt Laurent Lorenzo Louis Lucas Luis Manuel Mark Martin Matthew Michael Miguel Nicolas Oliver Otto Pablo Patrick Paul Peter Philipp Pierre Rafael Richard Robert Samuel Stefan Thomas Vincent Walter William".split()
)
# Words of streets and of dates of birth, and months.
STREETS = r"Street|St|Road|Rd|Avenue|Ave|Lane|Ln|Drive|Boulevard|Blvd|Court|Square|Terrace|Place|Crescent"
BORN = r"[Bb]orn(?: on)?|[Dd]ate of [Bb]irth|DOB|D\.O\.B\.|[Gg]eb(?:oren|\.)(?: am)?|[Nn]ée? le|[Nn]acid[oa] el|[Dd]ate de naissance|[Ff]echa de nacimiento|[Gg]eburtsdatum"
MONTHS = (
    "january february march april may june july august september october november december".split(),
    "jan feb mar apr may jun jul aug sep oct nov dec".split(),
    "januar februar märz april mai juni juli august september oktober november dezember".split(),
    "janvier février mars avril mai juin juillet août septembre octobre novembre décembre".split(),
    "enero febrero marzo abril mayo junio julio agosto septiembre octubre noviembre diciembre".split(),
)

#: The alphabets that letters keep to: vowels and consonants of a script, by lower case.
ALPHABETS = (
    "aeiou", "bcdfghjklmnpqrstvwxyz", "áéíóúàèìòùâêîôûäëïöüãõåæøœ", "ñçßšž", "аеиоуыэюяё", "бвгджзйклмнпрстфхцчшщъьѓ", "αεηιουω",
    "βγδζθκλμνξπρστφχψ"
)
VOWELS = frozenset(ALPHABETS[0] + ALPHABETS[2] + ALPHABETS[4] + ALPHABETS[6])
LATIN = "abcdefghijklmnopqrstuvwxyz"
_KNOWN = frozenset("".join(ALPHABETS))

_NAME = r"(?:[^\W\d_]['’](?=[^\W\d_]))?[^\W\d_][^\W\d_]++(?:['’-][^\W\d_]++)*+"
_UPPER = "[" + "".join(c for c in map(chr, range(0x530)) if c.isupper()) + "]"  # Latin, Greek and Cyrillic
_LISTED = "|".join(x for n in sorted(GIVEN_F + GIVEN_M, key=len, reverse=True) for x in (n, n.upper()))
_TITLES = "|".join(TITLES_F + TITLES_M + TITLES_N)
_GIVEN = r"(?=" + _UPPER + r")\b(?:" + _LISTED + r")(?: (?=" + _UPPER + ")" + _NAME + r"){1,2}"
_CAP = _UPPER + r"[^\W\d_]++"
_MONTH = "|".join(sorted({m for own in MONTHS for m in own}, key=len, reverse=True))
_DATE = rf"\d{{4}}-\d\d-\d\d|\d{{1,2}}[./-]\d{{1,2}}[./-]\d{{4}}|\d{{1,2}}(?:st|nd|rd|th|\.)? (?:de )?(?i:{_MONTH})\.?,? (?:de )?\d{{4}}|(?i:{_MONTH})\.? \d{{1,2}}(?:st|nd|rd|th)?,? \d{{4}}"
_DIGIT, _SECRET, _CAPITAL = re.compile("[0-9]"), re.compile(r"(?i:passw|pwd|secret|api_?key)"), re.compile(_UPPER + r"[^\W\d_]++")
_CALLS = frozenset(x for n in TITLES_F + TITLES_M + TITLES_N + GIVEN_F + GIVEN_M for x in (n, n.upper()))


def hinted(text: str) -> bool:
    """Whether text may have an entity: most texts have no digit, no `@`, no secret's word and no title or listed name, which is soon seen."""
    return "@" in text or _DIGIT.search(text) is not None or ("=" in text or ":" in text) and _SECRET.search(text) is not None or not _CALLS.isdisjoint(_CAPITAL.findall(text))


ENTITY = re.compile(
    r"(?P<email>(?<![\w.+%-])[\w.+%-]++@[\w-]++(?:\.[\w-]++)++)"
    r"|(?P<secret>(?<![0-9A-Za-z])(?=[0-9A-Za-z_-]{0,127}[0-9])(?:[0-9a-f]{32,128}|[0-9A-F]{32,128}|(?:sk|pk|ghp|AKIA)[-_]?[0-9A-Za-z]{16,64})(?![0-9A-Za-z])"
    r"|(?<=[=:])(?:(?<=password[=:])|(?<=passwd[=:])|(?<=pwd[=:])|(?<=secret[=:])|(?<=api_key[=:])|(?<=apikey[=:])|(?<=PASSWORD[=:])|(?<=SECRET[=:])|(?<=API_KEY[=:]))[^\s\"'<>,;]{5,127}[^\s\"'<>,;.:!?)])"
    r"|(?P<ip>(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\.?\d))"
    r"|(?P<born>\b(?:" + BORN + r"):? (?P<date>" + _DATE + r"))(?!\d)"
    r"|(?P<ssn>(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-]))"
    r"|(?P<card>(?<!\d)(?:\d{4}[ -]\d{4}[ -]\d{4}[ -]\d{4}|\d{13,19})(?!\d))"
    r"|(?P<iban>(?<![0-9A-Za-z])[A-Z]{2}\d{2}(?: ?[0-9A-Z]{4}){3,7}(?: ?[0-9A-Z]{1,3})?(?![0-9A-Za-z]))"
    r"|(?P<phone>(?<![\d+])(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)|\d{2,4})[ .-]\d{3,4}[ .-]\d{3,4}(?:[ .-]\d{2,4})?(?!\d)|\+\d{8,14}(?!\d))"
    r"|(?P<street>(?<![\w.])\d{1,5}[A-Za-z]? (?:" + _CAP + r" ){1,3}?(?:" + STREETS + r")\b|(?<!\w)\d{1,4},? (?:rue|avenue|boulevard|place|chemin|allée) (?:de la |du |des |de |d['’]|l['’])?" + _CAP
    + r"|(?<!\w)(?:Calle|Avenida|Plaza|Paseo) (?:de la |del |de )?" + _CAP + r",? \d{1,4}(?!\d))"
    r"|(?P<strasse>(?<!\w)" + _UPPER + r"[^\W\d_]{2,40}(?:straße|strasse|weg|platz|allee|gasse) \d{1,4}[a-z]?(?!\w))"
    r"|(?P<person>" + _GIVEN + r"|\b(?P<title>" + _TITLES + r")\b\.? (?=[^\W\d_a-z])" + _NAME + r"(?: (?=[^\W\d_a-z])" + _NAME + r"){0,2})"
)
#: A word that may be a name, with what may belong to it; not part of a longer word.
MENTION = re.compile(r"(?<!\w)(?<!\w['’-])[^\W\d_]++(?:['’-][^\W\d_]++)*+(?!\w)")
OUT = pa.schema(
    [("doc_id", pa.int64()), ("text", pa.string()), ("n_entities", pa.int64()), ("n_distinct", pa.int64()), ("kinds", pa.string())]
)


def _mix(key: bytes, label: str, turn: int, value: int) -> int:
    return int.from_bytes(hashlib.blake2b(f"{label}|{turn}|{value}".encode(), key=key, digest_size=32).digest(), "big")


def _permute(v: int, n: int, key: bytes, label: str, undo: bool = False) -> int:
    """A keyed permutation of 0..n-1, or its inverse: alternating Feistel network with cycle walking."""
    a = math.isqrt(n - 1) + 1
    b = -(-n // a)
    while True:
        left, right = divmod(v, b)
        for i in reversed(range(ROUNDS)) if undo else range(ROUNDS):
            if i % 2 == 0:
                left = (left + (-1 if undo else 1) * _mix(key, label, i, right)) % a
            else:
                right = (right + (-1 if undo else 1) * _mix(key, label, i, left)) % b
        v = left * b + right
        if v < n:
            return v


def another(v: int, n: int, key: bytes, label: str) -> int:
    """The value after v on a keyed cycle through all of 0..n-1: a permutation without fixed points (n > 1)."""
    return _permute((_permute(v, n, key, label) + 1) % n, n, key, label, undo=True) if n > 1 else v


def _classes(text: str, letters: str, digits: str) -> list[str]:
    """For each character its alphabet, or itself. letters: 'kind' keeps vowels vowels, 'latin' takes A-Z as one alphabet."""
    out = []
    for c in text:
        if c.isdigit() and c.isascii():
            out.append(digits)
        elif letters == "latin" and c in LATIN:
            out.append(LATIN)
        else:
            out.append(next((x for x in ALPHABETS if c in x), c))
    return out


@lru_cache(100_000)
def like(text: str, key: bytes, kind: str, letters: str = "kind") -> str:
    """A string of the same format as lower-case text."""
    classes = _classes(text, letters, "0123456789")
    v, n = 0, 1
    for c, own in zip(text, classes):
        v, n = v * len(own) + own.index(c), n * len(own)
    v = another(v, n, key, f"{kind}|{'|'.join(classes)}")
    out = []
    for own in reversed(classes):
        v, i = divmod(v, len(own))
        out.append(own[i])
    return "".join(reversed(out))


def cased(new: str, old: str) -> str:
    return "".join(x.upper() if y.isupper() and len(x.upper()) == 1 else x for x, y in zip(new, old))


def luhn(digits: str) -> bool:
    doubled = [int(d) * (1 + i % 2) for i, d in enumerate(reversed(digits))]
    return sum(x - 9 * (x > 9) for x in doubled) % 10 == 0


def _digits_into(text: str, digits: str) -> str:
    it = iter(digits)
    return "".join(next(it) if c.isdigit() else c for c in text)


def _card(text: str, key: bytes) -> str:
    """A number keeps its issuer's digit and moves among the valid ones by its free digits."""
    old = "".join(c for c in text if c.isdigit())
    head = old[0] + like(old[1:-1], key, "card " + old[0])
    return _digits_into(text, next(head + d for d in "0123456789" if luhn(head + d)))


def is_card(text: str) -> bool:
    """A number with a right check digit, in the ranges that issuers of cards have."""
    digits = "".join(c for c in text if c.isdigit())
    return luhn(digits) and (digits[0] in "3456" or "2221" <= digits[:4] <= "2720")


#: Days that dates of birth move among.
FIRST_DAY, LAST_DAY = datetime.date(1900, 1, 1).toordinal(), datetime.date(2099, 12, 31).toordinal()


def folded(word: str) -> str:
    """A word in lower case, its long s and its i with or without a dot as plain ones: all that a search without regard to case takes for equal."""
    return unicodedata.normalize("NFKC", word).replace("İ", "i").replace("ı", "i").lower()


def _date(text: str, key: bytes) -> str | None:
    """Another day in the same notation, or None if text is no day of 1900 to 2099. Of two numbers the first is the day if it can be."""
    fields = re.findall(r"[^\W\d_]+|\d+", text)
    numbers = [f for f in fields if f.isdigit()]
    months = next((own for own in MONTHS if any(folded(f) in own for f in fields)), None)
    if months is None and len(numbers) != 3:
        return None
    if months:
        word = next(f for f in fields if folded(f) in months)
        order = [numbers[0], word, numbers[-1]]  # day, month, year
        d, m, y = int(numbers[0]), months.index(folded(word)) + 1, int(numbers[-1])
    elif len(numbers[0]) == 4:
        order = [numbers[2], numbers[1], numbers[0]]
        y, m, d = map(int, numbers)
    else:
        order = list(numbers) if int(numbers[1]) <= 12 else [numbers[1], numbers[0], numbers[2]]
        d, m, y = int(order[0]), int(order[1]), int(order[2])
    try:
        day = datetime.date(y, m, d).toordinal()
    except ValueError:
        return None
    if not FIRST_DAY <= day <= LAST_DAY:
        return None
    new = datetime.date.fromordinal(FIRST_DAY + another(day - FIRST_DAY, LAST_DAY - FIRST_DAY + 1, key, "day"))
    put = {
        "d": f"{new.day:0{len(order[0])}d}", "m": months[new.month - 1] if months else f"{new.month:0{len(order[1])}d}",
        "y": f"{new.year:04d}"
    }
    if months:
        put["m"] = put["m"].upper() if order[1].isupper() else put["m"].capitalize() if order[1][0].isupper() else put["m"]
    # The fields stand in the order of their first places in the text.
    kinds = iter(sorted("dmy", key=lambda k: _field_at(text, order["dmy".index(k)], "dmy".index(k), order)))
    return re.sub(r"\d+|[^\W\d_]+", lambda f: put[next(kinds)] if f[0].isdigit() or folded(f[0]) in (months or ()) else f[0], text)


def _field_at(text: str, field: str, k: int, order: list[str]) -> int:
    """Where a date's field stands; of equal numbers the day comes first unless the year leads."""
    same = [i for i in range(3) if order[i] == field]
    at = [m.start() for m in re.finditer(r"\d+|[^\W\d_]+", text) if m[0] == field]
    if len(same) > 1 and re.match(r"\d{4}-", text):
        same.reverse()
    return at[min(same.index(k), len(at) - 1)]


def _address(text: str, key: bytes) -> str:
    """Number and street's name are replaced; the words that make it a street stay."""
    keep = re.compile(rf"(?:{STREETS}|rue|avenue|boulevard|place|chemin|allée|Calle|Avenida|Plaza|Paseo|de|la|du|des|del|d|l)")
    def one(m: re.Match) -> str:
        w = m[0]
        if w.isdigit():
            return _digits_into(w, like(w, key, "house"))
        if len(w) == 1 or keep.fullmatch(w):
            return w
        tail = re.search(r"(?:straße|strasse|weg|platz|allee|gasse)$", w)
        head = w[: tail.start()] if tail else w
        low = head.lower()
        return (cased(like(low, key, "street"), head) if len(low) == len(head) else head) + w[len(head) :]
    return re.sub(r"\d+|[^\W\d_]+", one, text)


def _ip(text: str, key: bytes) -> str:
    v = 0
    for part in text.split("."):
        v = v * 256 + int(part)
    v = another(v, 256**4, key, "ip")
    return ".".join(str(v >> s & 255) for s in (24, 16, 8, 0))


# First digits of country codes of one and of two digits; all others have three.
CODES_1 = ("1", "7")
CODES_2 = "20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split()


def _phone_parts(text: str) -> tuple[int, str]:
    """Number of leading digits that stay (country code, trunk zeros), and the national number's digits."""
    digits = "".join(c for c in text if c.isdigit())
    head = 0
    if text.startswith("+"):
        head = 1 if digits[0] in CODES_1 else 2 if digits[:2] in CODES_2 else 3
    while head < len(digits) - 1 and digits[head] == "0":
        head += 1
    return head, digits[head:]


def _phone(text: str, key: bytes) -> str:
    """The national number is permuted in one form, with or without a country code or a trunk zero, and begins with no zero again."""
    head, old = _phone_parts(text)
    new = like(old, key, "phone")
    while new[0] == "0" != old[0]:
        new = like(new, key, "phone")
    return _digits_into(text, "".join(c for c in text if c.isdigit())[:head] + new)


def _listed(word: str, gender: str, key: bytes) -> str | None:
    """A listed name gives the next one of its gender on a keyed cycle, or, under a title of the other gender, one of that; None for another word."""
    name = word.capitalize()
    own = next((x for x in ((GIVEN_F, GIVEN_M) if gender != "m" else (GIVEN_M, GIVEN_F)) if name in x), None)
    if own is None:
        return None
    wanted = {"f": GIVEN_F, "m": GIVEN_M}.get(gender, own)
    if name in wanted:
        return wanted[another(wanted.index(name), len(wanted), key, "given " + wanted[0])].lower()
    return wanted[_mix(key, "given of the other list " + word, 0, 0) % len(wanted)].lower()


def _surname(word: str, key: bytes) -> str:
    """Letters of the same kinds, but no listed name; the letter before an apostrophe stays."""
    head = re.match(r"[^\W\d_]['’](?=[^\W\d_]{2})|", word)[0]
    word = word[len(head) :]
    new = like(word, key, "name")
    while new.capitalize() in GIVEN_F or new.capitalize() in GIVEN_M:
        new = like(new, key, "name")
    return head + new


def _bare(word: str) -> tuple[str, str]:
    """A name and its possessive ending, which is no part of it."""
    n = len(word) - 2 * (len(word) > 3 and word[-2] in "'’" and word[-1] in "sS")
    return word[:n], word[n:]


def _names(text: str, found: list[re.Match]) -> set[str]:
    """The names of the persons in text, in the cases in which they are looked for: those behind titles and listed given names, and pairs
    of capitalised words that a mail address has as its parts."""
    names = set()
    for m in found:
        if m.lastgroup in ("person", "title"):
            name = text[m.end("title") if m["title"] else m.start() : m.end()].removeprefix(".")
            names |= {_bare(w)[0] for w in name.split()}
    mails = {
        frozenset(p) for m in found if m.lastgroup == "email"
        and len(p := [x for x in re.split(r"[\W\d_]+", m[0].split("@")[0].lower()) if len(x) > 1]) == 2
    }
    if mails:
        before = None
        for m in MENTION.finditer(text):
            if before and m.start() == before.end() + 1 and text[before.end()] == " " and m[0][0].isupper() and before[0][0].isupper():
                pair = (before[0], _bare(m[0])[0])
                if frozenset(x.lower() for x in pair) in mails:
                    names |= set(pair)
            before = m
    return {x for n in names if n and not n[0].islower() for x in (n, n.capitalize(), n.upper())}


def _again(text: str, names: set[str], start: int, end: int):
    """(start, end) of the mentions of names between two places of text: up to three in a row."""
    run: list[int] = []
    for m in MENTION.finditer(text, start, end):
        if _bare(m[0])[0] in names:
            if run and run[2] < 3 and m.start() == run[1] + 1 and text[run[1]] == " ":
                run = [run[0], m.end(), run[2] + 1]
                continue
            if run:
                yield run[0], run[1]
            run = [m.start(), m.end(), 1]
    if run:
        yield run[0], run[1]


class Book:
    """The surrogates of one document's entities and names: equal for equal ones, and of different ones no two meet.

    genders: the gender that a title gives a name (in lower case) anywhere in the document.
    """

    def __init__(self, key: bytes, genders: dict[str, str] | None = None):
        self.key, self.genders = key, genders or {}
        self.names: dict[str, str] = {}
        self.owner: dict[tuple[str, str], str] = {}

    def name(self, word: str, given: bool) -> str:
        if word not in self.names:
            listed = _listed(word, self.genders.get(word, ""), self.key)
            new = listed if listed and (given or word.capitalize() in GIVEN_F + GIVEN_M) else _surname(word, self.key)
            tried = 0
            while self.owner.setdefault(("name", new), word) != word:
                tried += 1
                new = (_listed(new, "", self.key) or _surname(new, self.key)) if tried < WALK else _surname(word, self.key) + LATIN[tried % 26] * (tried - WALK + 1)
            self.names[word] = new
        return self.names[word]

    def surrogate(self, kind: str, text: str, title: str | None = None) -> str:
        if kind == "person":
            return self.person(text, title or "")
        old, new, tried = normal(kind, text), _surrogate(kind, text, self.key), 0
        while self.owner.setdefault((kind, normal(kind, new)), old) != old:
            tried += 1
            # Once many are taken, of a format of few values, a number behind it tells them apart.
            new = _surrogate(kind, new, self.key) if tried < WALK else f"{_surrogate(kind, text, self.key)}{tried}"
        return new

    def person(self, text: str, title: str) -> str:
        head = re.match(re.escape(title) + r"\.? ", text).end() if title else 0
        words = text[head:].split(" ")
        out = []
        for i, w in enumerate(words):
            w, own = _bare(w)
            low = unicodedata.normalize("NFC", w).lower()
            if len(low) != len(w):
                low = w  # a letter whose lower case is longer stays as it is
            new = self.name(low, i < len(words) - 1)
            out.append(cased(new, w) if len(new) == len(w) else new.upper() if w.isupper() and len(w) > 1 else new.capitalize())
            out[-1] += own
        return text[:head] + " ".join(out)


def normal(kind: str, text: str) -> str:
    """What is equal for the spellings of one entity."""
    if kind in ("card", "ssn"):
        return "".join(c for c in text if c.isdigit())
    if kind == "phone":
        return _phone_parts(text)[1]
    return re.sub(r"\s", "", text).lower() if kind == "iban" else text if kind == "secret" else text.lower()


def surrogate(kind: str, text: str, key: bytes, title: str | None = None) -> str:
    """The surrogate of one entity by itself; equal for equal entities, whatever their case and separators."""
    words = text.split(" ")
    gender = "f" if title in TITLES_F else "m" if title in TITLES_M else ""
    genders = {_bare(words[1])[0].lower(): gender} if title and gender and len(words) > 2 else {}
    return Book(key, genders).surrogate(kind, text, title)


def _surrogate(kind: str, text: str, key: bytes) -> str:
    if kind == "card":
        return _card(text, key)
    if kind == "ip":
        return _ip(text, key)
    if kind == "phone":
        return _phone(text, key)
    if kind == "born":
        at = re.search(rf"(?:{_DATE})$", text).start()
        return text[:at] + (
            _date(text[at:], key) or _digits_into(text[at:], like("".join(c for c in text[at:] if c.isdigit()), key, "no day"))
        )
    if kind in ("street", "strasse"):
        return _address(text, key)
    if kind == "secret" and re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", text):
        n = 16 ** len(text)
        new = f"{another(int(text, 16), n, key, f'hex {len(text)}'):0{len(text)}x}"
        return new.upper() if text.upper() == text else new
    if kind in ("secret", "iban"):
        # Case is part of a secret: letters are permuted as letters of one alphabet and keep their case. What names its kind stays.
        head = re.match(r"(?:(?:sk|pk|ghp|AKIA)[-_]?(?=[0-9A-Za-z]{16}))?", text)[0] if kind == "secret" else ""
        text, low = text[len(head) :], text[len(head) :].lower()
        return head + cased(like(low, key, kind, "latin"), text) if len(low) == len(text) else head + like(text, key, kind, "latin")
    if kind == "email":
        local, _, domain = text.rpartition("@")
        name, dot, top = domain.rpartition(".")
        parts = []
        for k, x in (("local", local), ("domain", name)):
            # Letters without an alphabet here, or whose lower case is longer, become ones of a-z.
            low = "".join(c.lower() if len(c.lower()) == 1 and (c.lower() in _KNOWN or not c.isalpha()) else LATIN[ord(c) % 26] for c in x)
            parts.append(cased(like(low, key, "email " + k), x))
        return f"{parts[0]}@{parts[1]}{dot}{top}"
    return _digits_into(text, like("".join(c for c in text if c.isdigit()), key, kind))


def check(replaced: dict[tuple[str, str], str], titles: dict[str, str] | None = None) -> None:
    """Different entities of a document have different surrogates, and each name of a person one of its own. Raises if two meet."""
    for kind in {k for k, _ in replaced}:
        own = {old.lower(): new.lower() for (k, old), new in replaced.items() if k == kind}
        if kind == "person":
            words: dict[str, str] = {}
            for old, new in own.items():
                title = (titles or {}).get(old, "")
                for a, b in zip(old[len(title) :].split(), new[len(title) :].split()):
                    words[_bare(a)[0].strip(".")] = _bare(b)[0].strip(".")
            words.pop("", None)
            if len(set(words.values())) < len(words):
                raise ValueError("two names of persons share a surrogate")
        elif len(set(own.values())) != len(own):
            # Spellings of one entity may meet; different entities may not.
            bare = lambda s: re.sub(r"[^\w@.]", "", s)
            if len({bare(x) for x in own.values()}) < len({bare(x) for x in own}):
                raise ValueError(f"two entities of kind {kind} share a surrogate")


def replace_text(text: str | None, key: bytes) -> tuple[str | None, int, int, str]:
    """(text with surrogates, entities, different entities, kinds as `kind:count` in order of kind)."""
    new, made, kinds, _ = replacements(text, key)
    return new, sum(kinds.values()), len(made), ",".join(f"{k}:{n}" for k, n in sorted(kinds.items()))


def replacements(text: str | None, key: bytes) -> tuple[str | None, dict[tuple[str, str], str], dict[str, int], dict[str, str]]:
    """(text with surrogates, surrogates by (kind, entity), entities by kind, titles by person in lower case)."""
    if not text or not hinted(text):
        return text, {}, {}, {}
    made: dict[tuple[str, str], str] = {}
    kinds: dict[str, int] = {}
    titles: dict[str, str] = {}

    def put(kind: str, old: str, title: str | None = None) -> str:
        if (kind, old) not in made:
            made[kind, old] = book.surrogate(kind, old, title)
            titles[old.lower()] = (title or "").lower()
        kinds[kind] = kinds.get(kind, 0) + 1
        return made[kind, old]

    found = [m for m in ENTITY.finditer(text) if m.lastgroup != "card" or is_card(m[0])]
    names, parts, at = _names(text, found), [], 0
    genders: dict[str, str] = {}
    for m in found:
        words = m[0].split(" ")
        if m["title"] in TITLES_F + TITLES_M and len(words) > 2:
            genders.setdefault(_bare(words[1])[0].lower(), "f" if m["title"] in TITLES_F else "m")
    book = Book(key, genders)

    def between(end: int) -> None:
        """Text outside the entities, up to end."""
        start = at
        for a, b in _again(text, names, at, end) if names else ():
            parts.extend((text[start:a], put("person", text[a:b])))
            start = b
        parts.append(text[start:end])

    for m in found:
        between(m.start())
        kind = {"title": "person", "date": "born", "strasse": "street"}.get(m.lastgroup, m.lastgroup)
        parts.append(put(kind, m[0], m["title"]))
        at = m.end()
    between(len(text))
    return "".join(parts), made, kinds, titles


def session_key(spark: SparkSession) -> bytes:
    """The key that the session's setting spark.vellum.surrogates.key names; where it is unset, one drawn for this session, which then holds it."""
    found = spark.conf.get("spark.vellum.surrogates.key", None)
    if not found:
        found = secrets.token_hex(32)
        spark.conf.set("spark.vellum.surrogates.key", found)
    return hashlib.blake2b(found.encode(), digest_size=32).digest()


def replace_entities(docs: DataFrame, key: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, text with surrogates, n_entities, n_distinct, kinds.

    key: a secret of up to 64 bytes; equal keys give equal surrogates, in every run. The whole text is searched. Null text stays
    null and empty text empty, with no entities; repeated rows get the same surrogates; an empty table gives no rows.
    """
    if not 0 < len(key) <= 64:
        raise ValueError("the key has 1 to 64 bytes")

    def run(batches):
        for batch in batches:
            found = [replace_text(t.as_py(), key) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array([f[i] for f in found], type=OUT.types[i + 1]) for i in range(4))], schema=OUT
            )

    return spread(docs).select(column(id_col).cast("long").alias("doc_id"), column(text_col).alias("text")).mapInArrow(
        run, "doc_id long, text string, n_entities long, n_distinct long, kinds string"
    )
