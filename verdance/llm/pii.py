"""PII replacement by keyed surrogates.

Entities (e-mail addresses, telephone, card, bank account and social security numbers, network addresses, personal names) are found in the
whole text and replaced by surrogates of the same type and form. A surrogate is the image of the entity under a keyed permutation of all
strings of its form: letters stay letters of their script and case, digits digits, check digits stay as right or wrong as they were. Listed first
names stay in the list of their gender and script; other words of names never become listed ones, and keep a vowel at their end, by which many
languages tell gender. A permutation maps different entities to different surrogates and equal ones to equal ones in
every text and run, without any exchange between executors; ``collisions`` checks that over a whole result.

Names are found after forms of address, by listed first names, after words that introduce a name (``CUES``), before an e-mail address in brackets,
and where two capitalised words are the two parts of an e-mail address in the text; then each part of a found name wherever else it stands.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from bisect import bisect_right
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from ipaddress import IPv6Address

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, ship_by_value

ROUNDS = 6
#: Alphabets within which a character may change (fixed values); for letters of none of them ``alphabet`` makes one.
ALPHABETS = (
    "0123456789",
    "aeiou",
    "bcdfghjklmnpqrstvwxyz",
    "àáâãäåèéêëìíîïòóôõöøùúûü",
    "çðñýþ",
    "аеёиоуыэюя",
    "бвгджзйклмнпрстфхцчшщъь",
    "αεηιουω",
    "βγδζθκλμνξπρστφχψ",
    "אבגדהוזחטיכלמנסעפצקרשת",
    "ابتثجحخدذرزسشصضطظعغفقكلمنهوي",
    "あいうえおかきくけこさしすせそたちつてとなにぬねのはひふへほまみむめもやゆよらりるれろわ",
    "アイウエオカキクケコサシスセソタチツテトナニヌネノハヒフヘホマミムメモヤユヨラリルレロワ",
)
ALPHABET_OF = {c: (a, i) for a in ALPHABETS for i, c in enumerate(a)}
HAN = (0x4E00, 0x9FA5)
HANGUL = (0xAC00, 0xD7A3)
VOWELS = frozenset("aeiouyàáâãäåèéêëìíîïòóôõöøùúûüаеёиоуыэюяαεηιουωάέήίόύώ")
#: Code points in a block of letters of one script and kind.
BLOCK = 128


@lru_cache(maxsize=4096)
def alphabet(c: str) -> tuple[str | int, int, int] | None:
    """What a small letter or digit may become: the letters, or the first of a range, its place among them and how many there are."""
    if c in ALPHABET_OF:
        letters, at = ALPHABET_OF[c]
        return letters, at, len(letters)
    for low, high in (HAN, HANGUL):
        if low <= ord(c) <= high:
            return low, ord(c) - low, high - low + 1
    if not c.isalpha():
        return None
    base, kind = ord(c) // BLOCK * BLOCK, unicodedata.category(c)
    letters = "".join(x for x in map(chr, range(base, base + BLOCK)) if x not in ALPHABET_OF and unicodedata.category(x) == kind and _whole(x))
    return (letters, letters.index(c), len(letters)) if c in letters and len(letters) > 1 else None


def _whole(c: str) -> bool:
    """Whether changing a letter's case and back gives the letter."""
    return len(c.upper()) == 1 and c.upper().lower() == c

#: First names by gender and script, forms of address and words that introduce a name (fixed values).
FIRST_NAMES = (
    "James Robert John Michael David William Richard Joseph Thomas Charles Daniel Matthew Anthony Steven Andrew Kenneth George Edward Brian Ronald "
    "Peter Paul Mark Kevin Jason Hans Klaus Jürgen Wolfgang Stefan Andreas Pierre Philippe Nicolas Laurent Carlos Miguel Javier Fernando Alejandro Diego "
    "Łukasz Piotr Paweł Mohammed Ahmed Omar Ali Rahul Arjun Raj Hiroshi Wei".split(),
    "Mary Patricia Jennifer Linda Elizabeth Barbara Susan Jessica Sarah Karen Nancy Margaret Sandra Ashley Kimberly Emily Michelle Amanda Melissa Deborah "
    "Alice Emma Laura Julia Zoe Ursula Monika Petra Sabine Brigitte Katharina Nathalie Sylvie Françoise Céline Isabelle Carmen Dolores Lucía Pilar Mercedes "
    "Agnieszka Katarzyna Fatima Aisha Priya Anjali Yuki Mei".split(),
    "Александр Дмитрий Сергей Андрей Алексей Иван Михаил Николай Владимир Павел".split(),
    "Анна Мария Елена Ольга Наталья Татьяна Ирина Екатерина Светлана Людмила".split(),
    "Γιώργος Δημήτρης Κώστας Νίκος Γιάννης".split(),
    "Μαρία Ελένη Κατερίνα Βασιλική Σοφία".split(),
)
FIRST_NAME_OF = {name.lower(): (names, i) for names in FIRST_NAMES for i, name in enumerate(names)}
TITLES = (
    "Mr Mrs Ms Miss Mister Dr Doctor Prof Professor Sir Dame Rev Herr Frau Monsieur Madame Mademoiselle Mme Mlle Señor Señora Señorita Sr Sra Don Doña "
    "Господин Госпожа Κύριος Κυρία".split()
)
CUES = (
    "my name is", "i am called", "mein name ist", "ich heiße", "je m'appelle", "je m’appelle", "mon nom est", "me llamo", "mi nombre es", "меня зовут",
    "name:", "author:", "signed:", "attn:", "contact:", "from:", "sincerely,", "regards,", "grüßen,", "cordialement,", "atentamente,",
)



def _marks() -> str:
    """Vowel and other signs that belong to the letter before them, as ranges of a character class."""
    at = [c for c in range(0x300, 0x10000) if unicodedata.category(chr(c)) in ("Mn", "Mc")]
    firsts = [c for i, c in enumerate(at) if not i or at[i - 1] != c - 1]
    lasts = [c for i, c in enumerate(at) if i + 1 == len(at) or at[i + 1] != c + 1]
    return "".join(f"{chr(a)}-{chr(b)}" for a, b in zip(firsts, lasts, strict=True))


_CAPITAL = r"[^\W\d_a-zß-öø-ÿа-яα-ω]"
_REST = rf"[^\W\d_]*(?:[{_marks()}]+[^\W\d_]*)*"
_WORD = rf"[^\W\d_]{_REST}"
_NAME = rf"{_CAPITAL}(?=[^\W\d_]|[-'’{_marks()}]){_REST}(?:[-'’]{_WORD})*"
_TITLE = rf"(?:{'|'.join(TITLES)})\b\.?\x20"
TITLED = re.compile(rf"\b{_TITLE}(?:{_TITLE})*(({_NAME})(?:\x20({_NAME}))?)")
FULL_NAME = re.compile(rf"\b({_CAPITAL}[^\W\d_]{_REST})(?=\x20{_CAPITAL})\x20({_NAME})")
CUED = re.compile(rf"(?:(?<=^)|(?<=\W))(?i:{'|'.join(map(re.escape, CUES))})\s+({_NAME}(?:\x20{_NAME}){{0,2}})", re.M)
BRACKETED = re.compile(rf"\b({_NAME}(?:\x20{_NAME}){{1,2}})\x20?[<(](?=[^\s<>()@]+@)")
#: Anything that starts like a number; what it is gets settled by the patterns below.
NUMBERLIKE = re.compile(r"(?<![^\W_])(?:\+\x20?)?\(?\d[\d().:\x20-]*\d(?![^\W_])")
IPV4 = re.compile(r"(?<![\d.])(\d{1,3})\.(\d{1,3})\.(\d{1,3})\.(\d{1,3})(?!\.?\d)")
CARD = re.compile(r"(?<![\d+(-])(?:\d{13,19}|\d{4}([\x20-])\d{4}\1\d{4}\1\d{1,7}|\d{4}([\x20-])\d{6}\2\d{5})(?![\d-])")
SSN = re.compile(r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])")
PHONE = re.compile(r"(?<![\d(+])(?:\+\x20?\d{1,3}[\x20.-]?)?(?:\(\d{2,4}\)[\x20.-]?|\d{2,4}[\x20.-])\d{3,4}[\x20.-]\d{4}(?![\d-])|(?<![\d(+])\+\d{8,15}(?!\d)|(?<![\d(+])\+\d{1,3}(?:[\x20.-]\d{2,4}){3,5}(?![\d-])")
IBAN = re.compile(r"(?<![^\W_])[A-Z]{2}\d{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,4})?(?![^\W_])")
IPV6 = re.compile(r"(?<![\w:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![\w:])")
_H, _V4 = "[0-9A-Fa-f]{1,4}", r"\d{1,3}(?:\.\d{1,3}){3}"
#: With zeros left out by two colons, or ending like an address of the older form; the library for addresses has the last word.
SHORT_IPV6 = re.compile(rf"(?<![\w:])(?:(?:{_H}(?::{_H})*)?::(?:(?:{_H}:)*{_V4}(?!\.?\d)|{_H}(?::{_H})*)?|(?:{_H}:){{6}}{_V4}(?!\.?\d))(?![\w:])")
LETTERS = re.compile(_WORD)
DOMAIN = re.compile(r"[^\W_](?:[\w-]*[^\W_])?(?:\.[^\W_](?:[\w-]*[^\W_])?)*\.[^\W\d_]{2,}")
LOCAL_SIGNS = frozenset("._%+-")


@dataclass(frozen=True)
class Entity:
    start: int
    end: int
    kind: str
    source: str
    surrogate: str


class Surrogates:
    """Keyed permutations; equal keys give equal surrogates."""

    def __init__(self, key: bytes):
        self.key = hashlib.sha256(key).digest()
        self.known: dict[tuple[str, str], str] = {}

    def _number(self, tweak: str, i: int, x: int, bits: int) -> int:
        size = -(-bits // 8)
        out, block = b"", 0
        while len(out) < size:
            h = hashlib.blake2b(f"{tweak}|{bits}|{i}|{block}|{x}".encode(), key=self.key, digest_size=min(64, size))
            out += h.digest()
            block += 1
        return int.from_bytes(out[:size], "big") & ((1 << bits) - 1)

    def _walk(self, tweak: str, x: int, n: int, order: range) -> int:
        """A Feistel network on twice ``half`` bits, walked until the number is one below ``n`` again."""
        half = max(1, -(-(n - 1).bit_length() // 2))
        mask = (1 << half) - 1
        while True:
            a, b = x >> half, x & mask
            for i in order:
                if order.step > 0:
                    a, b = b, a ^ self._number(tweak, i, b, half)
                else:
                    a, b = b ^ self._number(tweak, i, a, half), a
            x = a << half | b
            if x < n:
                return x

    def permute(self, tweak: str, x: int, n: int) -> int:
        """A permutation of the numbers below ``n`` without fixed points (if ``n`` is over 1)."""
        if n < 2:
            return x
        tweak = f"{tweak}|{n}"
        y = (self._walk(tweak, x, n, range(ROUNDS)) + 1) % n
        return self._walk(tweak, y, n, range(ROUNDS - 1, -1, -1))

    def letters(self, kind: str, text: str, kept: int = -1) -> str:
        """Every letter and digit but the one at place ``kept`` becomes one of its alphabet; case stays in place and doesn't matter for which."""
        small = [c.lower() if len(c.lower()) == 1 else c for c in text]
        places = []
        x, n, form = 0, 1, []
        for i, c in enumerate(small):
            known = None if i == kept else alphabet(c)
            if known is None:
                form.append(c)
                continue
            letters, at, size = known
            form.append(f"<{letters[:1] if isinstance(letters, str) else letters}>")
            places.append((i, letters, size))
            x, n = x * size + at, n * size
        x = self.permute(f"{kind}|{''.join(form)}", x, n)
        for i, letters, size in reversed(places):
            x, at = divmod(x, size)
            c = letters[at] if isinstance(letters, str) else chr(letters + at)
            small[i] = c.upper() if text[i] != text[i].lower() and len(c.upper()) == 1 else c
        return "".join(small)

    def digits(self, kind: str, text: str, skip: int = 0, last: Callable[[str], int] | None = None) -> str:
        """New digits in the places of the old ones but the first ``skip``; ``last`` gives the check digit that the others call for."""
        at = [i for i, c in enumerate(text) if c.isdigit()][skip:]
        old = "".join(text[i] for i in at)
        body = old[:-1] if last else old
        new = str(self.permute(f"{kind}|{len(body)}", int(body), 10 ** len(body))).zfill(len(body)) if body else ""
        if last:
            new += str((last(new) + int(old[-1]) - last(body)) % 10)
        out = list(text)
        for i, c in zip(at, new, strict=True):
            out[i] = c
        return "".join(out)

    def first_name(self, name: str) -> str:
        names, i = FIRST_NAME_OF[name.lower()]
        other = names[self.permute("first|" + names[0], i, len(names))]
        return other.upper() if name.isupper() else other

    def name_word(self, word: str) -> str:
        """A listed first name for a listed one; for another word one that is not listed: the permutation is walked until it is none."""
        if word.lower() in FIRST_NAME_OF:
            return self.first_name(word)
        kept = len(word) - 1 if len(word) > 2 and word[-1].lower() in VOWELS else -1
        out = self.letters("name", word, kept)
        while out.lower() in FIRST_NAME_OF:
            out = self.letters("name", out, kept)
        return out

    def of(self, kind: str, source: str) -> str:
        if (kind, source) not in self.known:
            if len(self.known) > 100_000:
                self.known.clear()
            self.known[kind, source] = self._of(kind, source)
        return self.known[kind, source]

    def _of(self, kind: str, source: str) -> str:
        if kind == "email":
            local, _, domain = source.rpartition("@")
            name, _, top = domain.rpartition(".")
            return f"{self.letters('local', local)}@{self.letters('domain', name)}.{top}"
        if kind == "ipv4":
            x = int.from_bytes(bytes(map(int, source.split("."))), "big")
            return ".".join(map(str, self.permute(kind, x, 1 << 32).to_bytes(4, "big")))
        if kind == "ipv6":
            x = self.permute(kind, int(IPv6Address(source)), 1 << 128)
            return ":".join(f"{x:032x}"[i : i + 4] for i in range(0, 32, 4))
        if kind == "card":
            return self.digits(kind, source, last=luhn)
        if kind == "phone":
            return self.digits(kind, source, skip=_country_digits(source))
        if kind == "iban":
            plain = source.replace(" ", "")
            body = self.letters(kind, plain[4:])
            new = iter(plain[:2] + str(98 - _mod97(body + plain[:2] + "00")).zfill(2) + body)
            return "".join(c if c == " " else next(new) for c in source)
        if kind == "name":
            return LETTERS.sub(lambda m: self.name_word(m[0]), source)
        return self.digits(kind, source)


def _country_digits(phone: str) -> int:
    """Digits of the country code, which stay: those before the national number's last ten."""
    if not phone.startswith("+"):
        return max(0, sum(c.isdigit() for c in phone) - 10)
    head = re.match(r"\+\x20?(\d{1,3})(?=[\x20.(-])", phone)
    return len(head[1]) if head else max(0, sum(c.isdigit() for c in phone) - 10)


def luhn(body: str) -> int:
    """The check digit that ``body`` calls for."""
    total = 0
    for i, c in enumerate(reversed(body)):
        d = int(c) * (2 if i % 2 == 0 else 1)
        total += d - 9 if d > 9 else d
    return -total % 10


def _mod97(text: str) -> int:
    return int("".join(str(int(c, 36)) for c in text)) % 97


def _emails(text: str) -> Iterator[tuple[int, int, str]]:
    at, floor = text.find("@"), 0
    while at >= 0:
        start = at
        while start > floor and (text[start - 1].isalnum() or text[start - 1] in LOCAL_SIGNS):
            start -= 1
        while start < at and text[start] in LOCAL_SIGNS:
            start += 1
        m = DOMAIN.match(text, at + 1)
        if start < at and m:
            yield start, m.end(), "email"
            floor = m.end()
        else:
            floor = at + 1
        at = text.find("@", floor)


def _numbers(text: str) -> Iterator[tuple[int, int, str]]:
    for run in NUMBERLIKE.finditer(text):
        if run.end() - run.start() < 7:
            continue
        taken: list[tuple[int, int]] = []
        for kind, pattern in (("ipv4", IPV4), ("ssn", SSN), ("card", CARD), ("phone", PHONE)):
            for m in pattern.finditer(text, run.start(), run.end()):
                if kind == "ipv4" and any(int(g) > 255 or (len(g) > 1 and g[0] == "0") for g in m.groups()):
                    continue
                if all(m.end() <= a or m.start() >= b for a, b in taken):
                    taken.append((m.start(), m.end()))
                    yield m.start(), m.end(), kind


def _capital(word: str) -> bool:
    """Whether a word starts like a name: with a capital, or in a script without them."""
    return word[0].isupper() or word[0].lower() == word[0].upper()


def _names(text: str, emails: list[tuple[int, int, str]]) -> Iterator[tuple[int, int, str]]:
    """Names by their surroundings or a listed first name; then each of their parts wherever else it stands."""
    small = text.lower()
    patterns = (TITLED, CUED) if any(cue in small for cue in CUES) else (TITLED,)
    found = [m.span(1) for pattern in patterns for m in pattern.finditer(text) if all(map(_capital, m[1].split()))]
    if emails:
        found += [m.span(1) for m in BRACKETED.finditer(text) if all(map(_capital, m[1].split()))]
    addressed = {tuple(w) for a, b, _ in emails if len(w := [x for x in LETTERS.findall(text[a:b].partition("@")[0].lower()) if len(x) > 1]) == 2}
    at = 0
    while m := FULL_NAME.search(text, at):
        known = m[1].lower() in FIRST_NAME_OF or (m[1].lower(), m[2].lower()) in addressed or (m[2].lower(), m[1].lower()) in addressed
        if known and _capital(m[1]) and _capital(m[2]):
            found.append(m.span())
            at = m.end()
        else:
            at = m.end(1)  # the second word may be a first name itself
    # The O of O'Brien is no name by itself; a surname of one character is.
    parts = {w.lower() for a, b in found for name in text[a:b].split() for w in LETTERS.findall(name) if len(w) > 1 or w == name}
    if parts:
        found += [m.span() for m in LETTERS.finditer(text) if _capital(m[0]) and m[0].lower() in parts]
    for a, b in found:
        yield a, b, "name"


def _others(text: str) -> Iterator[tuple[int, int, str]]:
    if ":" in text:
        for m in IPV6.finditer(text):
            yield m.start(), m.end(), "ipv6"
        for m in SHORT_IPV6.finditer(text) if "::" in text or "." in text else ():
            # Names in programs (a::b) have two parts and no digit.
            if (m[0].count(":") > 2 or any(c.isdigit() for c in m[0])) and _is_ipv6(m[0]):
                yield m.start(), m.end(), "ipv6"
    for m in IBAN.finditer(text):
        plain = m[0].replace(" ", "")
        if 15 <= len(plain) <= 34 and _mod97(plain[4:] + plain[:4]) == 1:
            yield m.start(), m.end(), "iban"


def _is_ipv6(text: str) -> bool:
    try:
        IPv6Address(text)
    except ValueError:
        return False
    return True


def find(text: str, surrogates: Surrogates) -> list[Entity]:
    """The entities of a text from left to right; of overlapping ones the kind found first counts."""
    spans: list[tuple[int, int, str]] = []
    for finder in (_emails, _others, _numbers):
        spans += finder(text)
    spans += _names(text, [x for x in spans if x[2] == "email"])
    out = []
    rank = {"email": 0, "iban": 1, "ipv6": 1, "ipv4": 2, "ssn": 2, "phone": 2, "card": 2, "name": 3}
    kept = _without_overlaps(sorted(spans, key=lambda s: (rank[s[2]], s[0], -s[1])))
    for start, end, kind in kept:
        source = text[start:end]
        out.append(Entity(start, end, kind, source, surrogates.of(kind, source)))
    return out


def _without_overlaps(spans: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Those that overlap none before them in the list."""
    starts: list[int] = []
    kept: list[tuple[int, int, str]] = []
    for span in spans:
        i = bisect_right(starts, span[0])
        if (i and kept[i - 1][1] > span[0]) or (i < len(kept) and kept[i][0] < span[1]):
            continue
        starts.insert(i, span[0])
        kept.insert(i, span)
    return kept


def replace(text: str, entities: list[Entity]) -> str:
    out, at = [], 0
    for e in entities:
        out += [text[at : e.start], e.surrogate]
        at = e.end
    return "".join([*out, text[at:]])


ENTITY = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("source_key", pa.string()), ("surrogate", pa.string())])


def canonical(kind: str, source: str) -> str:
    """What makes two entities one: case and, in numbers, signs don't."""
    if kind in ("card", "ssn"):
        return "".join(c for c in source if c.isdigit())
    if kind == "phone":
        return "".join(c for c in source if c.isdigit())[-10:]
    if kind == "ipv6":
        return IPv6Address(source).exploded
    return source.replace(" ", "").lower() if kind == "iban" else source.lower()


def surrogate_documents(docs: DataFrame, key: bytes, text: str = "text", row_id: str = "doc_id") -> DataFrame:
    """``doc_id, text, n_entities, entities`` of every row; entities are ``kind, start, end, source_key, surrogate``.

    Starts and ends are code points in the old text; ``source_key`` is a keyed hash that tells entities apart without
    naming them. A null text stays null and has no entities; texts without entities stay as they are; repeated rows are replaced alike; an empty
    table gives no rows; other columns are ignored.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        surrogates = Surrogates(key)
        for batch in batches:
            texts, counts, entities = [], [], []
            for t in batch.column(1).to_pylist():
                found = find(t, surrogates) if t else []
                texts.append(replace(t, found) if found else t)
                counts.append(len(found))
                entities.append(
                    [
                        {
                            "kind": e.kind,
                            "start": e.start,
                            "end": e.end,
                            "source_key": hashlib.blake2b(f"{e.kind}|{canonical(e.kind, e.source)}".encode(), key=surrogates.key, digest_size=12).hexdigest(),
                            "surrogate": e.surrogate,
                        }
                        for e in found
                    ]
                )
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(texts, pa.string()), pa.array(counts, pa.int32()), pa.array(entities, pa.list_(ENTITY))], ["doc_id", "text", "n_entities", "entities"]
            )

    rows = docs.select(F.col(row_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return map_arrow(rows, work, "doc_id long, text string, n_entities int, entities array<struct<kind:string,start:int,end:int,source_key:string,surrogate:string>>")


def replace_texts(docs: DataFrame, key: bytes, text: str = "text") -> DataFrame:
    """``docs`` with all its columns, the texts with surrogates in place of entities.

    Null and empty texts stay as they are, repeated rows are replaced alike, no row goes; an empty table gives no rows.
    """
    place = docs.columns.index(text)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        surrogates = Surrogates(key)
        for batch in batches:
            texts = [replace(t, find(t, surrogates)) if t else t for t in batch.column(place).to_pylist()]
            yield batch.set_column(place, batch.schema.field(place), pa.array(texts, batch.schema.field(place).type))

    return map_arrow(docs, work, docs.schema)


def checked(replaced: DataFrame) -> DataFrame:
    """``replaced`` after a look at all of it for ``collisions``, which are an error. Computed twice rather than kept on disk."""
    found = collisions(replaced).limit(5).collect()
    if found:
        raise ValueError(f"surrogates that stand for more than one entity: {[(r['kind'], r['sources']) for r in found]}")
    return replaced


def collisions(replaced: DataFrame) -> DataFrame:
    """``kind, surrogate_key, sources``: surrogates that stand for more than one entity; none are expected. Counted after partial sums."""
    pairs = replaced.select(F.explode("entities").alias("e")).select("e.kind", F.lower("e.surrogate").alias("surrogate"), "e.source_key")
    digits = F.when(F.col("kind").isin("card", "ssn"), F.regexp_replace("surrogate", "[^0-9]", "")).when(
        F.col("kind") == "phone", F.right(F.regexp_replace("surrogate", "[^0-9]", ""), F.lit(10))
    )
    pairs = pairs.select("kind", F.coalesce(digits, "surrogate").alias("surrogate_key"), "source_key").distinct()
    return pairs.groupBy("kind", "surrogate_key").agg(F.count(F.lit(1)).alias("sources")).where("sources > 1")


ship_by_value(__name__)
