"""Personal information inside free text: found, and replaced by typed placeholders with linked pseudonyms.

Numbers are validated by shape, by label where the shape alone says little, and by their number blocks where nothing but the shape speaks for them. Numbers
and dates of birth are keyed-permuted within their format by a Feistel network: valid numbers stay valid (blocks and check
digits), dates stay dates. Names, addresses and emails get a keyed hash of their normalised spelling. So equal values stay linked across documents,
whoever holds the key, without a table of values.

Names are recognised by parts. The given and family names of the contributors are split into beginnings and
endings that recur, so that people built from the same parts are recognised without being listed; an
automaton finds family names, and the words around one decide. Signature lines name people of any spelling.
"""

from __future__ import annotations

import base64
import hashlib
import re
import secrets
from bisect import bisect_left
from collections.abc import Iterable, Iterator
from datetime import date, timedelta
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomgraph.llm.feistel import permute, pseudonym

MAX_LISTED_PEOPLE = 200_000
ROWS_A_BATCH = 1024
KEY_SETTING = "spark.fathomgraph.pii.key"

SPACES = " \t\u00a0\u2007\u2009\u202f"
SPACE = "[ \\t\\u00a0\\u2007\\u2009\\u202f]"
_LABEL = r"[A-Za-z0-9](?:[A-Za-z0-9-]{0,62}[A-Za-z0-9])?"
_LOCAL = r"[A-Za-z0-9](?:[A-Za-z0-9._%+-]{0,63})"
_AT = rf"(?:{SPACE}*[\(\[\{{]{SPACE}*at{SPACE}*[\)\]\}}]{SPACE}*)"
_DOT = rf"(?:{SPACE}*[\(\[\{{]{SPACE}*dot{SPACE}*[\)\]\}}]{SPACE}*|{SPACE}+dot{SPACE}+|\.)"
PLAIN_DOMAIN = re.compile(rf"(?:{_LABEL}\.)+[A-Za-z]{{2,24}}(?![A-Za-z0-9-])")
PLAIN_LOCAL = re.compile(r"[A-Za-z0-9._%+-]{1,64}\Z")
BRACKETED = re.compile(rf"(?<![\w.%+-]){_LOCAL}{_AT}{_LABEL}(?:{_DOT}{_LABEL})+(?![\w-])", re.I)
SPOKEN = re.compile(rf"(?<![\w.%+-]){_LOCAL}{SPACE}+at{SPACE}+{_LABEL}(?:{SPACE}+dot{SPACE}+{_LABEL})+(?![\w-])", re.I)

_SEP = rf"(?:{SPACE}|[-.])"
#: North American, then international with a plus or 00, then national with a leading 0.
PHONE = re.compile(
    r"(?<![\w.+/@#$%&-])(?<!\d:)" + rf"(?<![\d)]{SPACE})(?:"
    rf"(?:\+?1{_SEP}?)?(?:\(\d{{3}}\){SPACE}?|\d{{3}}{_SEP})\d{{3}}{_SEP}\d{{4}}"
    r"|\+1\d{10}"
    rf"|(?:\+|00{SPACE})[1-9]\d{{0,2}}(?:(?:{_SEP}|/)?\(?\d{{1,5}}\)?){{2,6}}"
    rf"|\(?0\d{{2,4}}\)?(?:{_SEP}|/)\d{{3,4}}(?:{_SEP}?\d{{3,4}}){{1,2}}"
    r")(?!\w)(?![-./:]\d)"
)
PHONE_LABELLED = re.compile(
    r"(?:\btel|\bphone|\bmobile?|\bfax|\bvoice|\bcell|\bcall|\bpager\b[^\n:]*|\brufnummer|\btelefon\w*|\btéléphone|\bteléfono|\bon-call)"
    rf"{SPACE}*[:=]?{SPACE}*(\+?\(?\d(?:(?:{SPACE}|[-./()]){{0,2}}\d){{7,14}})(?!\w)(?![-./:]\d)",
    re.I,
)
PHONE_DIGITS = range(8, 16)

#: Label of an identity number, what may stand between, and the number.
_ID_LABELS = (
    r"ssn\b",
    rf"social{SPACE}+security(?:{SPACE}+(?:number|no\.?|#))?",
    rf"soc\.?{SPACE}+sec\.?(?:{SPACE}+(?:no|nr|number)\.?)?",
    rf"passport(?:{SPACE}+(?:number|no\.?|nr\.?|id))?",
    r"reisepass(?:-?nr\.?|nummer)?",
    rf"tax(?:payer)?{SPACE}+(?:id|number|no\.?|identification(?:{SPACE}+number)?)",
    r"tin\b",
    r"steuer(?:-?id|-?nr\.?|-?nummer|identifikationsnummer)\b\.?",
    rf"(?:personnel|staff|employee|badge|payroll)(?:{SPACE}+|-)(?:number|no\.?|nr\.?|id)",
    r"personal(?:-?nr\.?|nummer)",
    rf"n[uú]m[eé]ro{SPACE}+(?:de{SPACE}+)?(?:pasaporte|passeport)",
    r"(?:nif|dni)\b",
)
ID_LABELLED = re.compile(
    rf"\b(?:{'|'.join(_ID_LABELS)})"
    rf"""(?:{SPACE}|["':=#,]){{0,6}}(?:"value"{SPACE}*:)?{SPACE}*(?:is\b|was\b|lautet\b|=|:|#)?{SPACE}*["'(]?{SPACE}*"""
    r"([A-Z]{0,3}\d[0-9]*(?:[- ][0-9]+)*(?:-?[A-Z])?)(?![\w])",
    re.I,
)
#: Shapes that say it all: 3-2-4 digits in one kind of separator, and 4-4 digits with a letter.
ID_SHAPED = re.compile(r"(?<![\w.+:/@#-])(?<!\d )(?:\d{3}([- ])\d{2}\1\d{4}|\d{4}-\d{4}-[A-Z])(?![\w])(?![-.:/]\d)(?! \d)")

_WORD = r"[^\W\d_]+(?:['’-][^\W\d_]+)*"
_CAP = r"(?:[^\W\d_a-zà-öø-ÿ]" + r"[^\W\d_]*(?:['’-][^\W\d_]+)*)"
_EN_TYPE = r"(?:street|road|lane|avenue|square|terrace|close|boulevard|drive|court|place|crescent|gardens|grove|hill|mews|row|walk|way|parkway|circle|alley|(?:st|rd|ln|ave|sq|ter|cl|blvd|dr|ct|pl|cres|pkwy)\.|(?:st|rd|ave|blvd)(?=\s*(?:$|[,;\n])))"
ADDRESS_EN = re.compile(rf"(?<![\w.:/-])\d{{1,5}}{SPACE}?[A-Za-z]?{SPACE}+(?:{_WORD}{SPACE}+){{1,3}}{_EN_TYPE}(?![\w])", re.M)
#: Endings of German street names, and beginnings of Spanish ones.
DE_TYPES = ("straße", "strasse", "str.", "gasse", "weg", "allee", "platz", "ring", "damm", "ufer", "steig")
ES_TYPES = ("calle", "avenida", "avda.", "plaza", "paseo", "camino", "ronda")
DE_NUMBER = re.compile(rf"{SPACE}+\d{{1,4}}(?:{SPACE}?[A-Za-z])?(?![\w-])(?!\.\d)")
DE_LEAD = re.compile(rf"(?:(?<![\w-]){_CAP}{SPACE}+){{0,2}}(?<![\w-])[^\W\d_]*(?:-[^\W\d_]*)*\Z")
ADDRESS_FR = re.compile(
    rf"(?<![\w.:/-])\d{{1,4}}(?i:{SPACE}?(?:bis|ter|[a-z])?,?{SPACE}+(?:rue|avenue|av\.|boulevard|bd|place|quai|impasse|allée|chemin|cours|route){SPACE}+"
    rf"(?:(?:de|du|des|la|le|les|d['’]|l['’]){SPACE}*){{0,3}}){_WORD}(?:{SPACE}+{_CAP})*"
)
ADDRESS_ES = re.compile(rf"(?<![\w-])(?:calle|avenida|avda\.|plaza|paseo|camino|ronda){SPACE}+(?:(?:de|del|la|las|los|el){SPACE}+){{0,3}}{_WORD}(?:{SPACE}+{_WORD}){{0,3}},?{SPACE}+\d{{1,4}}{SPACE}?[a-z]?(?![\w-])(?!\.\d)")

SIGNED = re.compile(rf"(?m)^{SPACE}*(?:[A-Z][\w-]*-by|Author|Committer|Cc|From):{SPACE}+(?:(?:Dr|Prof|Mr|Mrs|Ms)\.?{SPACE}+)?({_CAP}(?:,?{SPACE}+(?:[^\W\d_]\.|{_CAP})){{1,3}}){SPACE}+<")
_LETTERS = r"[^\W\d_]"
_NAME_WORD = rf"{_LETTERS}+(?:['’](?!s\b){_LETTERS}+)?"


def recurring_parts(names: Iterable[str], least: int = 2) -> tuple[frozenset[str], frozenset[str]]:
    """Beginnings and endings of names that each combine with at least `least` of the other kind.

    Every split of a name is a pair of numbers; pairs without enough partners go, again and again, until all that are left have them.
    """
    begins: dict[str, int] = {}
    ends: dict[str, int] = {}
    pairs = np.array([(begins.setdefault(n[:i], len(begins)), ends.setdefault(n[i:], len(ends))) for n in sorted(set(names)) for i in range(2, len(n) - 1)], np.int64).reshape(-1, 2)
    while True:
        b, e = np.bincount(pairs[:, 0], minlength=len(begins)), np.bincount(pairs[:, 1], minlength=len(ends))
        live = (b[pairs[:, 0]] >= least) & (e[pairs[:, 1]] >= least)
        if live.all():
            return frozenset(x for x, k in begins.items() if b[k] >= least), frozenset(x for x, k in ends.items() if e[k] >= least)
        pairs = pairs[live]


class NameBook:
    """Given and family names, listed or built of the listed ones' recurring parts; compared in lower case.

    Halves of a word are looked up when the word comes up, so the book grows with the list alone. Recent words are remembered.
    """

    REMEMBERED = 200_000

    def __init__(self, people: Iterable[tuple[str | None, str | None]]):
        given, family = set(), set()
        for g, f in people:
            given.update(p for p in re.split(r"[\s-]+", (g or "").strip().lower()) if len(p) > 1)
            family.update(p for p in re.split(r"[\s-]+", (f or "").strip().lower()) if len(p) > 1)
        self.given, self.given_parts = frozenset(given), recurring_parts(given)
        self.family, self.family_parts = frozenset(family), recurring_parts(family)
        #: Names that are more than a run of letters are looked for as they are.
        self.odd = ahocorasick.Automaton()
        for name in family:
            if not _RUN.fullmatch(name):
                self.odd.add_word(name, len(name))
        if len(self.odd):
            self.odd.make_automaton()
        self.known: dict[str, bool] = {}

    @staticmethod
    def _is(word: str, names: frozenset[str], parts: tuple[frozenset[str], frozenset[str]]) -> bool:
        begins, ends = parts
        return word in names or any(word[:i] in begins and word[i:] in ends for i in range(2, len(word) - 1))

    def is_family(self, word: str) -> bool:
        out = self.known.get(word)
        if out is None:
            if len(self.known) >= self.REMEMBERED:
                self.known.clear()
            out = self.known[word] = self._is(word, self.family, self.family_parts)
        return out

    def is_given(self, word: str) -> bool:
        return self._is(word.lower(), self.given, self.given_parts)

    def is_given_name(self, words: str) -> bool:
        return all(self.is_given(w) for w in words.split("-"))

    def families(self, low: str) -> list[tuple[int, int]]:
        """Where family names stand in a lower-cased text."""
        every = {w.decode() for w in set(low.encode().translate(_LETTERS_ALONE).split())} if low.isascii() else set(_RUN.findall(low))
        named = {w for w in every if self.is_family(w)}
        spans = [m.span() for m in _RUN.finditer(low) if m.group() in named] if named else []
        if len(self.odd):
            spans += [(end + 1 - n, end + 1) for end, n in self.odd.iter(low)]
        return sorted(spans)


_RUN = re.compile(_LETTERS + "+")
_LETTERS_ALONE = bytes(c if chr(c).isalpha() and c < 128 else 32 for c in range(256))


def token_start(text: str, at: int, tokens: int) -> int:
    """Where the last `tokens` words ahead of `at` begin, in the line of `at`."""
    line = text.rfind("\n", 0, at) + 1
    spaces = [c for c in SPACES if c in text]
    for _ in range(tokens):
        while at > line and text[at - 1] in SPACES:
            at -= 1
        at = max([line, *(text.rfind(c, line, at) + 1 for c in spaces)])
    return at


_BEFORE = re.compile(rf"(?:(?P<initial>(?<![\w.]){_LETTERS}\.(?:{SPACE}?{_LETTERS}\.)?)|(?<![\w@.+/-])(?P<given>{_NAME_WORD}(?:-{_NAME_WORD})*)(?P<middle>{SPACE}+{_LETTERS}\.?)?){SPACE}+\Z")
_AFTER = re.compile(rf"{SPACE}*,{SPACE}*(?:(?P<initial>{_LETTERS}\.(?:{SPACE}?{_LETTERS}\.)?)|(?P<given>{_NAME_WORD}(?:-{_NAME_WORD})*)(?![\w@/])(?:{SPACE}+{_LETTERS}\.)?)")
_AFTER_PLAIN = re.compile(rf"{SPACE}+(?P<given>{_NAME_WORD}(?:-{_NAME_WORD})*)(?![\w@/]|\.[\w])(?:{SPACE}+{_LETTERS}\.)?")
_HYPHEN_ON = re.compile(rf"(?:-{_NAME_WORD})+")


def _names(text: str, low: str, book: NameBook) -> Iterator[tuple[int, int]]:
    done = 0
    for start, end in book.families(low):
        if start < done:
            continue
        if start and (text[start - 1].isalnum() or text[start - 1] in "_@+/"):
            continue
        if end < len(text) and (text[end].isalnum() or text[end] in "_@"):
            continue
        while (m := _HYPHEN_ON.match(text, end)) and all(book.is_family(p.lower()) for p in m.group()[1:].split("-")):
            end = m.end()
        if end < len(text) and (text[end] in "-_@+" and end + 1 < len(text) and text[end + 1].isalnum()):
            continue
        lead = text[token_start(text, start, 3) : start]
        hit = None
        if m := _BEFORE.search(lead):
            if m["initial"] or book.is_given_name(m["given"]):
                hit = (start - (len(lead) - m.start()), end)
            elif m["middle"] and m["middle"].endswith("."):  # a word of the sentence, then an initial
                hit = (start - (len(lead) - m.end("middle") + len(m["middle"].strip())), end)
        if hit is None and (m := _AFTER.match(text, end)):
            if m["initial"] or book.is_given_name(m["given"]):
                hit = (start, m.end())
        if hit is None and (m := _AFTER_PLAIN.match(text, end)) and book.is_given_name(m["given"]):
            hit = (start, m.end())
        if hit and hit[0] >= done:
            done = hit[1]
            yield hit


def _emails(text: str, low: str) -> Iterator[tuple[int, int]]:
    at = text.find("@")
    while at >= 0:
        local = PLAIN_LOCAL.search(text[max(0, at - 64) : at])
        domain = PLAIN_DOMAIN.match(text, at + 1)
        if local and domain:
            start = at - len(local.group().lstrip(".-%+"))
            start += len(text[start:at]) - len(text[start:at].lstrip("._%+-"))
            before, after = text[max(0, start - 3) : start], text[domain.end() : domain.end() + 2]
            remote = len(after) == 2 and after[0] in ":/" and (after[1].isalnum() or after[1] in "~/_.") or before.endswith("://")
            if start < at and text[at - 1] != "." and not remote:
                yield start, domain.end()
        at = text.find("@", at + 1)
    if "at" in low:
        if re.search(r"[(\[{]\s*at\s*[)\]}]", low):
            for m in BRACKETED.finditer(text):
                if not m.group().split()[-1].replace(".", "").isdigit():
                    yield m.span()
        if re.search(r"\sat\s", low) and re.search(r"\sdot\s", low):
            for m in SPOKEN.finditer(text):
                yield m.span()


#: Six digits or more with what may stand between them: every number that can be meant lies in one, or begins just before.
NUMBER = re.compile(rf"\d(?:(?:{SPACE}|[-./()]){{0,2}}\d){{5,}}")


def has_us_blocks(digits: str) -> bool:
    """Ten digits, or eleven with a leading 1, whose area and exchange start with 2 to 9, as North American numbers do."""
    digits = digits.removeprefix("1") if len(digits) == 11 else digits
    return len(digits) == 10 and digits[0] > "1" and digits[3] > "1"


def has_id_blocks(digits: str) -> bool:
    """Nine digits in blocks of 3, 2 and 4, of which none is all zeros; other lengths have no blocks."""
    return len(digits) != 9 or digits[:3] != "000" and digits[3:5] != "00" and digits[5:] != "0000"


def has_check_digit(digits: str) -> bool:
    """Eleven digits whose last is the check digit of ISO 7064 MOD 11,10, as in German tax numbers."""
    if len(digits) != 11 or digits[0] == "0":
        return False
    product = 10
    for d in digits[:10]:
        product = ((int(d) + product) % 10 or 10) * 2 % 11
    return (11 - product) % 10 == int(digits[10])


def _numbers(text: str) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """Identity numbers, and phone numbers. Labels are looked for from the number before, or the start of the line, on."""
    ids, phones, before = [], [], 0
    for m in NUMBER.finditer(text):
        start, end = m.span()
        base = max(before, text.rfind("\n", before, start) + 1)
        near = text[base : end + 6]
        for x in ID_LABELLED.finditer(near):
            if 6 <= sum(c.isdigit() for c in x.group(1)) <= 14:
                ids.append((base + x.start(1), base + x.end(1)))
        for x in PHONE_LABELLED.finditer(near):
            if sum(c.isdigit() for c in x.group(1)) in PHONE_DIGITS and not re.fullmatch(r"\d{3,4}([-.])\d\d?\1\d\d?", x.group(1)):
                phones.append((base + x.start(1), base + x.end(1)))
        at = max(0, start - 2)
        while at < end:
            if (x := ID_SHAPED.match(text, at)) and has_id_blocks(re.sub(r"\D", "", x.group())):
                ids.append(x.span())
            elif (x := PHONE.match(text, at)) and sum(c.isdigit() for c in x.group()) in PHONE_DIGITS and (not US_PHONE.fullmatch(x.group()) or has_us_blocks(re.sub(r"\D", "", x.group()))):
                phones.append(x.span())
            at = x.end() if x else at + 1
        before = end
    return list(dict.fromkeys(ids)), list(dict.fromkeys(phones))


US_PHONE = re.compile(rf"(?:\+?1{_SEP}?)?(?:\(\d{{3}}\){SPACE}?|\d{{3}}{_SEP})\d{{3}}{_SEP}\d{{4}}")

#: What tells a date of birth, and the names of months.
BIRTH_WORDS = ("birth", "born", "dob", "d.o.b", "geb", "né", "naissance", "nacid", "nacimiento")
BIRTH_LABEL = rf"(?:date{SPACE}+of{SPACE}+birth|birth{SPACE}?da(?:te|y)|d\.?o\.?b\.?|born(?:{SPACE}+on)?|geburtsdatum|geboren(?:{SPACE}+am)?|geb\.|née?{SPACE}+le|date{SPACE}+de{SPACE}+naissance|nacid[oa](?:{SPACE}+el)?|fecha{SPACE}+de{SPACE}+nacimiento)"
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
_MONTH = "|".join(f"{m[:3]}(?:{m[3:]})?" for m in MONTHS)
BIRTH = re.compile(
    rf"(?<!\w){BIRTH_LABEL}(?:{SPACE}|[\"':=(]|is\b|was\b)*((?P<y>\d{{4}})-(?P<m>\d\d?)-(?P<d>\d\d?)|(?P<a>\d\d?)(?P<sep>[./-])(?P<b>\d\d?)(?P=sep)(?P<y2>\d{{4}})"
    rf"|(?P<name>{_MONTH}){SPACE}+(?P<d3>\d\d?),?{SPACE}+(?P<y3>\d{{4}})|(?P<d4>\d\d?){SPACE}+(?P<name4>{_MONTH}),?{SPACE}+(?P<y4>\d{{4}}))(?!\w)",
    re.I,
)
FIRST_DAY, DAYS = date(1900, 1, 1), (date(2100, 1, 1) - date(1900, 1, 1)).days


def _day_of(m: re.Match) -> date | None:
    """The day that a match of BIRTH names; where day and month could be either, dots mean day first, other signs month first."""
    day_first = m["sep"] == "." or int(m["a"]) > 12 if m["a"] else False
    month_of = lambda name: [n[:3] for n in MONTHS].index(name[:3].lower()) + 1
    if m["y"]:
        y, mo, d = m["y"], m["m"], m["d"]
    elif m["a"]:
        y, mo, d = (m["y2"], m["b"], m["a"]) if day_first else (m["y2"], m["a"], m["b"])
    else:
        y, mo, d = (m["y3"], month_of(m["name"]), m["d3"]) if m["name"] else (m["y4"], month_of(m["name4"]), m["d4"])
    try:
        day = date(int(y), int(mo), int(d))
    except ValueError:
        return None
    return day if FIRST_DAY <= day and (day - FIRST_DAY).days < DAYS else None


def _births(text: str, low: str) -> Iterator[tuple[int, int]]:
    if any(w in low for w in BIRTH_WORDS):
        for m in BIRTH.finditer(text):
            if _day_of(m):
                yield m.span(1)


def other_day(value: str, key: bytes) -> str:
    """A date of birth as another day in the same writing: its place among the days of 1900 to 2099, permuted."""
    m = BIRTH.fullmatch("born " + value)
    day = FIRST_DAY + timedelta(permute((_day_of(m) - FIRST_DAY).days, DAYS, key))
    wide = lambda n, like: f"{n:0{len(like)}d}" if like.startswith("0") or n > 9 else str(n) if len(like) == 1 else f"{n:02d}"
    if m["y"]:
        return f"{day.year}-{wide(day.month, m['m'])}-{wide(day.day, m['d'])}"
    if m["a"]:
        day_first = m["sep"] == "." or int(m["a"]) > 12
        a, b = (day.day, day.month) if day_first else (day.month, day.day)
        return f"{wide(a, m['a'])}{m['sep']}{wide(b, m['b'])}{m['sep']}{day.year}"
    month = MONTHS[day.month - 1].capitalize()
    return f"{month} {day.day}, {day.year}" if m["name"] else f"{day.day} {month} {day.year}"


#: Words before a street type that make it no address.
NOT_STREETS = frozenset("of in is at the a an to and or with for from by on ms s lines files functions symbols edges nodes rows times hops weeks months percent".split())


def _addresses(text: str, low: str) -> Iterator[tuple[int, int]]:
    for m in ADDRESS_EN.finditer(low):
        whole = text[m.start() : m.end()]
        words = re.findall(r"[^\W\d_]+", whole)
        words = words[1:] if len(words[0]) == 1 else words
        names = words[:-1]
        if names and not any(w.lower() in NOT_STREETS for w in names) and (all(w[0].isupper() for w in names) or whole.islower() and len(names) == 1 and whole.rstrip(".").split()[-1] in ("street", "avenue", "terrace", "boulevard", "st", "ave")):
            yield m.span()
    for kind in DE_TYPES:
        at = low.find(kind)
        while at >= 0:
            end = at + len(kind)
            if m := DE_NUMBER.match(text, end):
                own = DE_LEAD.search(text[token_start(text, at, 3) : at])
                words = own.group().split() if own else []
                if own and own.group()[-1:].isalpha():  # the type ends a word: that word alone is the street
                    yield at - len(words[-1]), m.end()
                elif words and text[at].isupper():  # the type is a word of its own, after the street's
                    yield at - len(own.group()), m.end()
            at = low.find(kind, end)
    for m in ADDRESS_FR.finditer(text):
        yield m.start(), m.end()
    if any(kind in low for kind in ES_TYPES):
        for m in ADDRESS_ES.finditer(low):
            yield m.span()


def find(text: str | None, book: NameBook) -> list[tuple[int, int, str]]:
    """(start, end, type) in order, without overlap: where finds overlap, the first of email, id number, phone, address, name and date of birth stays."""
    if not text:
        return []
    spans: list[tuple[int, int, str]] = []  # sorted, without overlap

    def add(kind: str, found: Iterable[tuple[int, int]]) -> None:
        for s, e in found:
            k = bisect_left(spans, (s, e, ""))
            if (k == 0 or spans[k - 1][1] <= s) and (k == len(spans) or spans[k][0] >= e):
                spans.insert(k, (s, e, kind))

    low = text.lower()
    if len(low) != len(text):  # a few letters change length; keep places aligned
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    add("email", _emails(text, low))
    ids, phones = _numbers(text)
    add("id_number", ids)
    add("phone", phones)
    add("address", _addresses(text, low))
    add("name", _names(text, low, book))
    add("name", (m.span(1) for m in SIGNED.finditer(text)))
    add("date", _births(text, low))
    return spans


def _tag(kind: str, value: str, key: bytes) -> str:
    """80 bits of a keyed hash: among 10 ** 9 values, two share one with a chance below one in a million."""
    return base64.b32encode(hashlib.blake2b(f"{kind}:{value}".encode(), key=key, digest_size=10).digest()).decode().lower()


def _tax_number(value: str, key: bytes) -> str:
    """A number with a check digit as another one: ten digits are permuted, the check digit is worked out anew."""
    digits = re.sub(r"\D", "", value)
    ten = pseudonym(digits[:10], key, valid=lambda d: d[0] != "0")
    new = next(ten + c for c in "0123456789" if has_check_digit(ten + c))
    it = iter(new)
    return re.sub(r"\d", lambda _: next(it), value)


def placeholder(kind: str, value: str, key: bytes) -> str:
    """`[PHONE:+1 (415) 555-0188]` and the like: the same for equal values.

    Phones keep the country's prefix and their layout, and link by national number; identity numbers keep their layout; dates their writing. Emails
    link by address, disguised or not; names by their words in any order and case; addresses by their letters and digits.
    """
    if kind == "phone":
        digits = re.sub(r"\D", "", value)
        if re.match(r"\+?44|0044", re.sub(r"[^\d+]", "", value)) or digits.startswith("0"):
            national = re.sub(r"^(0044|44)?0?", "", digits)
        else:
            national = digits[-10:]
        return f"[PHONE:{pseudonym(value, key, len(digits) - len(national), has_us_blocks if US_PHONE.fullmatch(value) else None)}]"
    if kind == "id_number":
        digits = re.sub(r"\D", "", value)
        if has_check_digit(digits) and not re.search("[A-Za-z]", value):
            return f"[ID_NUMBER:{_tax_number(value, key)}]"
        return f"[ID_NUMBER:{pseudonym(value.upper(), key, valid=has_id_blocks if len(digits) == 9 else None)}]"
    if kind == "date":
        return f"[DATE:{other_day(value, key)}]"
    if kind == "email":
        plain = re.sub(rf"{SPACE}*[(\[{{]?\bdot\b[)\]}}]?{SPACE}*", ".", re.sub(rf"{SPACE}*[(\[{{]?\bat\b[)\]}}]?{SPACE}*", "@", value.lower(), count=1))
        return f"[EMAIL:{_tag(kind, plain, key)}]"
    if kind == "name":
        words = sorted(w for w in re.findall(r"[^\W\d_]+", value.lower()) if len(w) > 1)
        return f"[NAME:{_tag(kind, ' '.join(words), key)}]"
    return f"[ADDRESS:{_tag(kind, ' '.join(re.findall(r'[^\W_]+', value.lower())), key)}]"


def found(text: str | None, book: NameBook, key: bytes) -> list[tuple[int, int, str, str]]:
    """(start, end, type, placeholder) of every find in order; none in null and empty texts. Finds and their pseudonyms come from here alone."""
    return [(s, e, kind, placeholder(kind, text[s:e], key)) for s, e, kind in find(text, book)]


def redact(text: str | None, book: NameBook, key: bytes) -> str | None:
    """text with every find replaced by its placeholder; null and empty texts as they are."""
    if not text:
        return text
    out, at = [], 0
    for s, e, _, instead in found(text, book, key):
        out += [text[at:s], instead]
        at = e
    return "".join([*out, text[at:]])


@lru_cache(4)
def _book(people: tuple[tuple[str | None, str | None], ...]) -> NameBook:
    """One per Python worker."""
    return NameBook(people)


def _people(contributors: DataFrame) -> tuple[tuple[str | None, str | None], ...]:
    """The distinct names of the list of people; refused beyond MAX_LISTED_PEOPLE, as every worker holds them."""
    names = contributors.select(F.col("given_name").cast("string"), F.col("family_name").cast("string")).distinct().limit(MAX_LISTED_PEOPLE + 1).collect()
    if len(names) > MAX_LISTED_PEOPLE:
        raise ValueError(f"more than {MAX_LISTED_PEOPLE} listed people")
    return tuple(sorted(((r[0], r[1]) for r in names), key=lambda x: (x[0] or "", x[1] or "")))


def _sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for start in range(0, b.num_rows, ROWS_A_BATCH):
            yield b.slice(start, ROWS_A_BATCH)


def secret_key(spark: SparkSession) -> bytes:
    """The key of the session's KEY_SETTING. Without one a random key is drawn: pseudonyms are then linked within one result, and nobody can undo them."""
    named = spark.conf.get(KEY_SETTING, None)
    return hashlib.sha256(named.encode()).digest() if named else secrets.token_bytes(32)


def pseudonyms(documents: DataFrame, contributors: DataFrame) -> DataFrame:
    """(doc_id, pii_type, found_value, placeholder): one row per document, type and distinct value as it stands in the text, with what replaces it.

    Types are those of personal_data, and date: dates of birth. Null, empty and blank texts have none. Texts are searched whole. contributors may be
    empty: names are then found in signature lines alone. Rows of documents count each for itself: doc_id is unique. Other columns are ignored.
    """
    people, key = _people(contributors), secret_key(documents.sparkSession)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        book = _book(people)
        for batch in _sliced(batches):
            rows = [(doc, *x) for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()) for x in dict.fromkeys((k, text[s:e], p) for s, e, k, p in found(text, book, key))]
            columns = [pa.array([r[0] for r in rows], pa.int64()), *[pa.array([r[i] for r in rows], pa.string()) for i in (1, 2, 3)]]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "pii_type", "found_value", "placeholder"])

    return documents.select("doc_id", "text").mapInArrow(search, "doc_id bigint, pii_type string, found_value string, placeholder string")


def personal_data(documents: DataFrame, contributors: DataFrame) -> DataFrame:
    """(doc_id, pii_type, found_value) of pseudonyms, for email, phone, id_number, address and name."""
    return pseudonyms(documents, contributors).filter("pii_type != 'date'").select("doc_id", "pii_type", "found_value")


def redacted(documents: DataFrame, contributors: DataFrame) -> DataFrame:
    """(doc_id, text): every document with its personal data, and dates of birth, replaced by placeholders; null texts stay null."""
    people, key = _people(contributors), secret_key(documents.sparkSession)

    def replace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        book = _book(people)
        for batch in _sliced(batches):
            texts = [redact(t, book, key) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return documents.select("doc_id", "text").mapInArrow(replace, "doc_id bigint, text string")
