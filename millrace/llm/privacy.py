"""p5: personal details in free text, by candidate gradient boosting.

High-recall generators propose overlapping spans for email addresses, numbers (telephone or
identity), street addresses and names of persons. Each candidate gets features of its format and
of the words around it; one set of boosted trees for each kind scores the candidates, a threshold
calibrated on held-out examples selects them, and of overlapping spans the best stays. Selected
spans are replaced by typed placeholders, so that the rest of the text stays readable.

The trees are trained here, on texts written by ``examples`` (a seeded generator with its own
templates); which words are first names, surnames and common words is counted over all rows of the
author table and all messages.
"""

from __future__ import annotations

import random
import re
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.boosting import Boosted
from millrace.session import cut, spread
from millrace.sources.tables import table

KINDS = ("email", "phone", "id_number", "address", "person_name")
PLACEHOLDER = {k: f"[{k.upper()}]" for k in KINDS}
#: Words are listed that make up at least this part of all names, or of all words of the messages,
#: so that no list that is broadcast can be longer; and the count that a common word needs.
PART, LEAST = 500_000, 3
#: Synthetic texts that the trees are trained on, and the precision that thresholds are set for.
TEXTS, PRECISION = 12000, 0.96
#: Every HELD-th template of a kind is held out: texts made of them set the thresholds.
HELD = 4

# Words beside numbers, forms of addresses, titles, and spoken digits.
_ID_WORDS = frozenset("ssn dni nif nie passport ausweis personalausweis reisepass pasaporte identity id id-card card steuer-id steueridentifikationsnummer nino insurance licence license national social".split())
_PHONE_WORDS = frozenset("tel telephone phone call ring whatsapp number mobile cell fax text sms ruf anrufen telefon handy llama teléfono móvil answers reach dial nummer printer ask".split())
_OTHER_WORDS = frozenset("order part ticket isbn issn invoice version item serial train platform score price went from to no parcel tracking track code model episode chapter page pages lot sku ref reference flight line room wins rechnung bestellung pedido factura bestellnummer artikel".split())
_FIRM_WORDS = frozenset("prize award cup medal trophy street road lane avenue square bridge ltd limited inc gmbh bros brothers sons co company bank works bakery hotel theatre school university festival fc united station".split())
_TITLES = frozenset("mr mrs ms miss dr prof professor herr frau señor señora senor senora sr sra don doña dona sir madam captain rev lady lord".split())
_DIGIT_WORDS = "oh|zero|one|two|three|four|five|six|seven|eight|nine|double|triple|hundred|null|eins|zwei|drei|vier|fünf|sechs|sieben|acht|neun|cero|uno|dos|tres|cuatro|cinco|seis|siete|ocho|nueve"
_STREETS = r"street|st|road|rd|avenue|ave|lane|ln|drive|dr|close|court|ct|way|square|sq|place|terrace|crescent|row|gardens|hill|walk|mews|grove|parade|boulevard|blvd|alley"

_NOISE = re.compile(r"https?://\S+|(?<![^\s(,;:!?.<])[@#][^\s@,;:!?()<>]+(?!\w)")
_HIDDEN = re.compile("[­​-‍⁠﻿]")
_EMAIL = re.compile(
    r"(?i)(?<![\w.+\-])[a-z0-9][\w.+\-]*(?:\s?[@]\s?|\s?[(\[{<]\s?at\s?[)\]}>]\s?|\s(?:at|arroba|ät)\s)[a-z0-9][\w\-]*(?:(?:\.|\s?[(\[{]\s?(?:dot|punkt|punto)\s?[)\]}]\s?|\s(?:dot|punkt|punto)\s)[a-z0-9\-]{2,})+"
)
_NUMBER = re.compile(r"(?<![\w/#])(?:\+?\(?\d[\d \t().\-/]{4,}\d(?:[ -]?[A-Za-z]\b)?|[A-Za-z]{1,2}[ -]?\d[\d \-]{4,}\d(?:[ -]?[A-Za-z]\b)?)(?!\w)")
_SPOKEN = re.compile(rf"(?i)\b(?:(?:{_DIGIT_WORDS})\b[\s-]*){{5,}}")
_ADDRESS_EN = re.compile(rf"(?i)(?<![\w.,/-])(?:(?:no|nr|apt|flat|unit)\.?\s+)?(\d{{1,4}}[a-z]?)(?:,\s*\d{{1,4}}[a-z]?)?,?\s+((?:[^\W\d_][\w'’\-]*\s+){{1,3}}?)({_STREETS})\b\.?")
_ADDRESS_DE = re.compile(r"(?i)\b([^\W\d_][\w\-]{0,60}?(?:straße|strasse|str\.|weg|gasse|platz|allee|ufer|damm|ring|steig|chaussee)|(?:am|an der|im|zum|zur)\s+[A-ZÄÖÜ][^\W\d_]+)\s+(?:nr\.?\s*)?(\d{1,4}\s?[a-z]?)\b(?:,\s*\d{4,5}\s+[^\W\d_][\w\-]+)?")
_ADDRESS_ES = re.compile(r"(?i)(?<!\w)(calle|c/|c\.|avenida|avda\.?|av\.|plaza|pza\.?|paseo|camino|ronda|travesía)\s*((?:(?:de|del|la|las|los|el)\s+)*[^\W\d_][\w'’\-]*(?:\s+(?:de|del|la|y)?\s*[^\W\d_][\w\-]*){0,2}?),?\s+(?:n[º°.o]*\s*)?(\d{1,4}[a-z]?)\b(?:,\s*\d{1,2}[º°]\s?[A-Za-z]?\b)?")
_TOKEN = re.compile(r"[^\W\d_]+(?:[-'’][^\W\d_]+)*\.?")
_DIGIT = re.compile(r"\d")
_WORDS = re.compile(r"\w+")
_SPOKEN_WORDS = frozenset([*_DIGIT_WORDS.split("|"), "funf"])
_INITIAL = re.compile(r"(?<![^\W\d_])[^\W\d_]\. ")

_WIDE = {c: c - 0xFEE0 for c in range(0xFF01, 0xFF5F)} | {0xA0: 0x20, 0x3000: 0x20, 0x202F: 0x20, 0x2010: 0x2D, 0x2011: 0x2D, 0x2012: 0x2D, 0x2013: 0x2D}
_MARKS = dict.fromkeys(range(0x300, 0x370))
_WIDE |= dict(zip(map(ord, "авеѕіјкмнорсԁтухѵАВЕЅІЈКМНОРСТУХ"), map(ord, "abesijkmhopcdtyxvABESIJKMHOPCTYX"), strict=True))


def readable(message: str) -> tuple[str, list[int] | None]:
    """The message with wide and look-alike signs replaced one by one and hidden ones removed, and
    where its signs stood before (None: unchanged)."""
    if message.isascii():
        return message, None
    text = message.translate(_WIDE)
    if not _HIDDEN.search(text):
        return text, None
    keep = [i for i, c in enumerate(text) if not _HIDDEN.match(c)]
    return "".join(text[i] for i in keep), keep


def _may_hold_email(text: str) -> bool:
    """Whether a text has one of the signs or words that every match of ``_EMAIL`` has."""
    small = text.lower()
    return "@" in small or "at" in small or "ät" in small or "arroba" in small


def plain_name(word: str) -> str:
    return word.lower() if word.isascii() else unicodedata.normalize("NFKD", word.lower()).translate(_MARKS)


def count_names(names: Iterable[str | None]) -> tuple[Counter, Counter]:
    """How often each word is a first name, and how often a surname."""
    first, last = Counter(), Counter()
    for name in names:
        parts = name.split() if name else ()
        if len(parts) >= 2:
            a, b = (parts[-1], parts[0][:-1]) if parts[0].endswith(",") else (parts[0], parts[-1])
            if len(a.strip(".")) > 2:
                first[plain_name(a)] += 1
            last[plain_name(b)] += 1
    return first, last


def count_words(messages: Iterable[str | None]) -> tuple[Counter, Counter]:
    """How often each word comes, and how often it begins with a small letter; no handles, links and emails."""
    tokens, words, lower = Counter(), Counter(), Counter()
    for m in messages:
        if m:
            text = readable(m)[0]
            if "@" in text or "#" in text or "://" in text:
                text = _NOISE.sub(" ", text)
            if _may_hold_email(text):
                text = _EMAIL.sub(" ", text)
            tokens.update(_TOKEN.findall(text))
    for t, n in tokens.items():
        w = t.rstrip(".")
        words[w.lower()] += n
        if w[0].islower():
            lower[w.lower()] += n
    return words, lower


class Lexicon:
    """First names, surnames and common words."""

    def __init__(self, names: list[str], messages: list[str]) -> None:
        first, last = count_names(names)
        words, lower = count_words(messages)
        self.fill([w for w, n in first.items() if n > last[w]], [w for w, n in last.items() if n > first[w]], [w for w, n in words.items() if n >= LEAST and lower[w] * 2 >= n])

    def fill(self, first: Iterable[str], last: Iterable[str], common: Iterable[str]) -> None:
        self.first, self.last = set(first), set(last)
        self._triggers()
        self.common = {w for w in common if w not in self.last and w not in self.first}

    def _triggers(self) -> None:
        self.triggers = {p for w in (self.first | self.last | _TITLES) for p in _WORDS.findall(w)}


def _case(w: str) -> int:
    return 0 if w.islower() else 2 if w.isupper() and len(w) > 1 else 1 if w[0].isupper() else 3


def _around(text: str, a: int, b: int) -> tuple[list[str], list[str]]:
    before = [w.strip(".:,;").lower() for w in text[max(0, a - 40) : a].split()[-4:]]
    return before, [w.strip(".:,;!?").lower() for w in text[b : b + 30].split()[:3]]


def _numbers(text: str, a: int, b: int, spoken: bool) -> list[float]:
    span = text[a:b]
    digits = re.sub(r"\D", "", span)
    groups = re.findall(r"\d+", span) or [""]
    before, after = _around(text, a, b)
    hit = lambda words, kinds: float(any(w in kinds or w.rstrip(":") in kinds for w in words))
    near = before[-2:]
    glued = re.search(r"([^\W\d_]+)[:.=]?$", text[max(0, a - 14) : a])
    near = near + ([glued[1].lower()] if glued else [])
    return [
        float(spoken), len(digits), len(groups), len(groups[0]), len(groups[-1]), max(map(len, groups)), min(map(len, groups)),
        float("+" in span), float(digits[:1] == "0"), float("(" in span), span.count("-"), span.count("."), span.count(" "), span.count("/"),
        float(span[-1:].isalpha() and not spoken), float(span[:1].isalpha() and not spoken), hit(near, _ID_WORDS), hit(before, _ID_WORDS), hit(near, _PHONE_WORDS), hit(before, _PHONE_WORDS),
        hit(near, _OTHER_WORDS), hit(before, _OTHER_WORDS), hit(after, _ID_WORDS | {"steuer"}), hit(after, _PHONE_WORDS), float("555" in groups), float(digits[:2] in ("97", "98", "00")),
        float(bool(re.match(r"\d{3}-\d{2}-\d{4}$", span))), float(bool(re.search(r"[.,]\d\d$", span))), float(not before), float(text[b : b + 1] in "%€$£"), float(digits[:2] or -1),
    ]


def _email(text: str, m: re.Match) -> list[float]:
    span = m[0]
    local = re.match(r"[\w.+\-]+", span)[0]
    tail = re.split(r"(?i)[^\w\-]+|\bdot\b", span)[-1].lower()
    spaced = float(bool(re.search(r"(?i)\sat\s", span)))
    return [spaced, float("@" in span), float(bool(re.search(r"(?i)[(\[{<]\s?at", span))), float(bool(re.search(r"(?i)\sdot\s|[(\[]dot", span))), float("." in span.split(local, 1)[-1]), len(tail), float(tail.isalpha()), len(local), float(bool(re.search(r"[\d.+_]", local))), float(local.lower() in ("look", "meet", "is", "was", "are", "laugh", "be", "the")), len(span)]


def _address(text: str, m: re.Match, kind: int) -> list[float]:
    before, after = _around(text, m.start(), m.end())
    name = m[2] if kind == 0 else m[1] if kind == 1 else m[2]
    words = name.split()
    last = before[-1] if before else ""
    return [
        float(kind), len(words), float(bool(words) and all(w[:1].isupper() for w in words)), float(last in ("platform", "gleis", "line", "route", "bus", "track", "read", "won", "lost", "from", "tram", "vía", "andén")),
        float(any(w in ("the", "a", "and", "of", "in", "for", "to", "with", "at", "on", "is", "was", "more", "times", "people", "years", "days", "hours", "pounds", "friends", "long", "new", "old", "by") for w in map(str.lower, words))),
        float(last in ("at", "to", "address", "adresse", "in", "an", "left", "moved", "come", "keys", "party", "no", "apt", "wir", "estamos", "someone", "painted")), float(any(w in ("side", "is", "closed", "shut", "was") for w in after[:1])),
        float(m[0][:1].isdigit()), len(re.search(r"\d+", m[0])[0]), float(bool(re.search(r"\d[a-z]", m[0], re.I))), float(m[0].isupper()), float(m[0].islower()), float(not before), float(len(words) > 0 and words[0][:1].islower() and any(w[:1].isupper() for w in words)),
    ]


def _names(text: str, lex: Lexicon) -> Iterator[tuple[int, int, list[float]]]:
    tokens = [(m.start(), m.end(), m[0]) for m in _TOKEN.finditer(text)]
    plain = [plain_name(t.rstrip(".")) for _, _, t in tokens]
    n = len(tokens)
    for i, (a, b, t) in enumerate(tokens):
        p = plain[i]
        title = p in _TITLES
        initial = len(p) == 1 and t[-1] == "." and t[0].isupper()
        first = p in lex.first
        shaped = t[0].isupper() and len(p) > 2 and p not in lex.common
        if not (title or initial or first or shaped) or i + 1 >= n:
            continue
        ends = []
        j = i + 1
        if text[b : tokens[j][0]] in (" ", "  ") and (t[-1] != "." or title or initial):
            inner = 0
            if not initial and len(plain[j]) == 1 and tokens[j][2][-1] == "." and j + 1 < n:
                j, inner = j + 1, 1
            elif title and plain[j] in lex.first and j + 1 < n and text[tokens[j][1] : tokens[j + 1][0]] == " ":
                j, inner = j + 1, 2
            if text[tokens[j - 1][1] : tokens[j][0]].strip(" ") == "":
                ends.append((j, 0, inner))
        elif text[b : tokens[j][0]] in (", ", ",") and plain[j] in lex.first and not first:
            k = j + 1
            more = k < n and len(plain[k]) == 1 and tokens[k][2][-1] == "." and text[tokens[j][1] : tokens[k][0]] == " "
            ends.append((j + more, 1, 0))
        for j, comma, inner in ends:
            s = i if comma else j
            word = tokens[s][2].rstrip(".")
            q = plain[s]
            if len(q) < 3 or not (title or initial or first or comma or q in lex.last):
                continue
            stop = tokens[j][1] - (tokens[j][2][-1] == "." and len(plain[j]) > 1)
            after = re.match(r"\W*([^\W\d_]+)", text[stop : stop + 24])
            following = after[1].lower() if after else ""
            before = _around(text, a, b)[0]
            yield a, stop, [
                float(title), float(initial), float(first), float(comma), float(inner), float(q in lex.last), float(q in lex.common), _case(word), _case(t.rstrip(".")) if len(p) > 1 else 1.0,
                float(following in _FIRM_WORDS), float(text[stop : stop + 3].lstrip()[:1] == "&"), float("-" in word), len(q), float(text[a - 1 : a] in ("@", "#", ".", "_")), float(text[stop : stop + 1] in ("@", "_")),
                float(following in ("is", "says", "said", "was")), float(bool(before) and before[-1] in _TITLES), float(q in lex.first), float(p in lex.common), float(p in lex.last), float(q in _FIRM_WORDS),
            ]


def candidates(text: str, lex: Lexicon) -> list[tuple[str, int, int, list[float]]]:
    """(kind, start, end, features) of every proposed span; handles, tags and links are no text here."""
    bare = _NOISE.sub(lambda m: "\x00" * len(m[0]), text) if "@" in text or "#" in text or "://" in text else text
    out: list[tuple[str, int, int, list[float]]] = []
    if _may_hold_email(bare):
        for m in _EMAIL.finditer(bare):
            out.append(("email", m.start(), m.end(), _email(bare, m)))
    if _DIGIT.search(bare):
        for m in _NUMBER.finditer(bare):
            e = m.end()
            f = _numbers(bare, m.start(), e, False)
            if f[1] >= 6:
                out += [("phone", m.start(), e, f), ("id_number", m.start(), e, f)]
        for kind, pattern in enumerate((_ADDRESS_EN, _ADDRESS_DE, _ADDRESS_ES)):
            for m in pattern.finditer(bare):
                out.append(("address", m.start(), m.end(), _address(bare, m, kind)))
    words = _WORDS.findall(plain_name(bare))
    for m in _SPOKEN.finditer(bare) if not _SPOKEN_WORDS.isdisjoint(words) and sum(w in _SPOKEN_WORDS for w in words) >= 3 else ():
        f = _numbers(bare, m.start(), m.end(), True)
        out += [("phone", m.start(), m.start() + len(m[0].rstrip(" -")), f), ("id_number", m.start(), m.end(), f)]
    # every name has a known part, a title or an initial
    for a, b, f in _names(bare, lex) if not lex.triggers.isdisjoint(words) or (". " in bare and _INITIAL.search(bare)) else ():
        out.append(("person_name", a, b, f))
    return out


# --- training texts: templates of this module's own, {slots} are filled by ``_Writer`` ---

_PLAIN = """we walked to the river and came home late|the new lamp in the hall works again|market day was fine this week|nobody saw the parcel|good morning from the harbour|der Zug kam pünktlich an|hoy llueve otra vez en el pueblo|the choir sang for two hours|{F} says hello to everyone|{F} was here yesterday|{T} cupboard is my hamster|Mr window is what we call the dog|the {S} Prize was given to a baker|{S} & Sons sell good rope|{S} Ltd opened a shop|the {S} Cup starts on Monday|{S} Hotel is full|{P} is lovely in spring|greetings from {P}|{F} and the others left early|{S} Street is open again|{P} Road is closed until May|I read {n} long streets of text|{n} avenues and no tram|platform {n} Mill Road exit is shut|the road to {P} was wet|{n} people stood at the court|we won {n} to {n}|meet me at the gate at {n}|look at the sky. so clear|be at the station at noon.now|{F} Street choir sings tonight|the lane behind our house|{F} Road school has a new roof|the queue at {F} Bakery was long|tea at the {F} Hotel again|{F} Square is full of pigeons|they meet at {F} Theatre|ask the baker at {P}. thanks""".split("|")
_WITH = {
    "email": "write to {X} please|{X}|mail {X} for tickets|my address is {X} from today|contact: {X}|mail={X}|<{X}>|({X}) or at the door|{N} <{X}>|schreib an {X} wenn du kommst|escribe a {X} hoy|send it to {X} or to me|{X} for orders, no visits|reach us under {X}|photos please to {X}",
    "phone": "call {X} tonight|{X}|tel {X}|tel:{X} for news|my number is {X} now|whatsapp {X}|ring {X} twice|{N}, {X}|ruf an: {X}|llama al {X} por la tarde|text {X} or write|the office answers on {X}|{X} - ask for the cook|lost dog, {X}|mobile {X}, evenings|{X} or {X}, either is fine|{X}. Ask for me|found keys near the mill, {X}|phone {X}",
    "id_number": "my SSN is {X}|passport no. {X}|{N}: {X}|why is {X} on this receipt|the bank wants {X}|renewing passport {X} takes weeks|found a card, {X}, by the gate|{W} {X}|do not post {W} {X} here|who lost {W} {X}|they printed my {W} {X} on the bill|{W} {X} was stolen|lost {X} on the bus, please help|the clerk wrote down {X} for me",
    "address": "we live at {X}|{X}|come to {X} at nine|parcel left at {X} again|my new address: {X}|{N}, {X}|party at {X} tonight|{X}: second floor|moved to {X} today|wir wohnen {X}|vivimos en {X}|keys are at {X}|somebody painted {X} green|{X} / {E}|skip the mill, meet me at {X}|{N} lives at {X}|it was delivered to {X} instead",
    "person_name": "met {X} at the market|{X}|thanks {X} for the boat|vote {X} for mayor|my dentist is {X}|lunch with {X} and {X}|{X} owes me money|happy birthday {X}!|grüße an {X} in {P}|saludos a {X}|so {X} mended the fence|{X} asked me for the key|{X} lives at number 9|{X}: hello|dinner with {X} on Friday|I saw {X} there|{X} wrote this song",
}
_NO_NUMBER = "order {Y} was sent|part no. {Y} is missing|ISBN {Y} is out of stock|ticket {Y} wins|invoice {Y} is paid|version {Y} crashes|price fell from {Y} to {Y}|train {Y} is late|tracking {Y}|score {Y} after an hour|item {Y} does not fit|Rechnung {Y} ist bezahlt|pedido {Y} enviado|serial {Y}|lot {Y} sold|model {Y} is new|reference {Y}"


class _Writer:
    """Seeded writer of labelled texts."""

    def __init__(self, seed: int) -> None:
        self.r = random.Random(seed)
        self.firsts = [self._made(1, 2) for _ in range(120)]
        self.lasts = [self._made(2, 3) for _ in range(300)]
        self.places = [self._made(2, 2) for _ in range(60)]

    def _made(self, least: int, most: int) -> str:
        r = self.r
        n = r.randint(least, most)
        w = "".join(r.choice(["b", "br", "d", "dr", "f", "g", "h", "k", "l", "m", "n", "p", "r", "s", "st", "t", "tr", "v", "w", "z"]) + r.choice("aeiou") + r.choice(["", "l", "n", "r", "s", "m", "ck"]) for _ in range(n))
        return (w + r.choice(["a", "o", "en", "ik", "or"]) if n < 2 else w).capitalize()

    def _digits(self, pattern: str) -> str:
        return "".join(self.r.choice("0123456789") if c == "9" else self.r.choice("ABCDEFGHKLMNPRSTXYZ") if c == "A" else c for c in pattern)

    def name(self) -> str:
        r = self.r
        f, s = r.choice(self.firsts), r.choice(self.lasts)
        if r.random() < 0.15:
            s += "-" + r.choice(self.lasts)
        out = r.choice([f"{f} {s}"] * 5 + [f"{f[0]}. {s}", f"{r.choice(['Mr', 'Mrs', 'Ms', 'Dr', 'Dr.', 'Prof', 'Herr', 'Frau', 'Señor', 'Señora'])} {s}", f"{f} {self._digits('A')}. {s}", f"{s}, {f}", f"Dr {f} {s}"])
        return r.choice([out] * 6 + [out.lower() if "." not in out else out, out.upper()])

    def phone(self) -> str:
        r = self.r
        if r.random() < 0.08:
            return " ".join(r.choice(["oh", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "double seven", "nine hundred"]) for _ in range(r.randint(7, 11)))
        return self._digits(r.choice(["020 7999 9999", "07999 999999", "07999999999", "+44 7999 999 999", "+44 20 7999 9999", "030/99999999", "030 9999999", "+49 (0)30 99999 999", "+49 30 9999999", "999.555.0199", "(999) 555-0199", "999-555-0199", "+1 999 555 0199", "+1 999-999-9999", "555-0199", "555 0199", "699 99 99 99", "+34 699 999 999", "0179 9999999", "01999 999999"]))

    def ident(self) -> tuple[str, str]:
        return (x := self.r.choice([("SSN", "999-99-9999"), ("SSN", "999999999"), ("SSN", "999 99 9999"), ("DNI", "99999999-A"), ("DNI", "99999999A"), ("Steuer-ID", "99 999 999 999"), ("Steuer-ID", "99999999999"), ("passport no.", "A99999999"), ("passport", "A9999999"), ("identity card", "A99999999"), ("NINO", "AA 99 99 99 A"), ("NINO", "AA999999A")]))[0], self._digits(x[1])

    def email(self) -> str:
        r = self.r
        f, s = r.choice(self.firsts).lower(), r.choice(self.lasts).lower()
        local = r.choice([f"{f}.{s}", f"{f[0]}{s}", f"{s}_{f}", f"{f}{s[:3]}{r.randint(10, 99)}", f"{f}+{s[:4]}", f"{s}{r.randint(1, 999)}", f])
        host, tld = r.choice(self.lasts).lower() + r.choice(["", "mail", "net", "box"]), r.choice([["com"], ["org"], ["de"], ["es"], ["test"], ["example"], ["invalid"], ["co", "uk"], ["co", "example"]])
        at, dot = r.choice([("@", ".")] * 5 + [("(at)", "."), ("[at]", "[dot]"), (" [at] ", "[dot]"), (" at ", " dot "), (" @ ", "."), (" (at) ", " (dot) ")])
        out = local + at + dot.join([host, *tld])
        return out.upper() if r.random() < 0.06 else out

    def address(self) -> str:
        r = self.r
        n, w = str(r.randint(1, 260)) + r.choice(["", "", "", "a", "b"]), r.choice(self.lasts)
        en = f"{n} {w} {r.choice(['Street', 'Street', 'St.', 'Road', 'Rd', 'Avenue', 'Lane', 'Close', 'Court', 'Drive', 'Square', 'Terrace'])}"
        out = r.choice([en, en, en, "No " + en, f"Apt {n}, {en}", f"{w}{r.choice(['straße', 'strasse', 'weg', 'gasse', 'platz', 'str.'])} {n}", f"{w}{r.choice(['straße', 'weg', 'gasse'])} {n}, {self._digits('99999')} {r.choice(self.places)}", f"{r.choice(['Calle', 'C/', 'Avenida', 'Plaza', 'Paseo'])} {w} {n}", f"Calle {w} {n}, {r.randint(1, 9)}º A"])
        return out.lower() if r.random() < 0.12 else out

    def other(self) -> str:
        return self._digits(self.r.choice(["4999-9999-99", "9999-99-9999", "978-0-99-999999-9", "99999999", "2999/2999", "10.9.99.9", "9,999.99", "99.999,99", "999999", "9999 9999", "A9-999999", "99-99999-99", "2019-09-29", "19.09.2019"]))

    def text(self, held: bool = False) -> tuple[str, list[tuple[str, int, int]]]:
        """A text and its details, from the templates for fitting or (``held``) from the others: every HELD-th of a kind."""
        r = self.r
        some = lambda templates: [t for n, t in enumerate(templates) if (n % HELD == HELD - 1) == held]
        parts, spans, at = [], [], 0
        for kind in r.sample([*KINDS, "plain", "plain", "number"], r.randint(1, 2)):
            if kind == "plain":
                t = r.choice(some(_PLAIN))
            elif kind == "number":
                t = r.choice(some(_NO_NUMBER.split("|")))
            else:
                t = r.choice(some(_WITH[kind].split("|")))
            for piece in re.split(r"(\{\w\})", t):
                own = None
                if piece == "{X}":
                    word, value = self.ident() if kind == "id_number" else ("", "")
                    piece, own = value or {"email": self.email, "phone": self.phone, "address": self.address, "person_name": self.name}[kind](), kind
                elif piece == "{N}":
                    piece, own = self.name(), "person_name"
                elif piece == "{E}":
                    piece, own = self.email(), "email"
                elif piece == "{W}":
                    piece = r.choice(["SSN", "DNI", "Steuer-ID", "passport no.", "identity card", "ID"])
                elif piece in ("{F}", "{S}", "{P}", "{T}", "{n}", "{Y}"):
                    piece = {"{F}": r.choice(self.firsts), "{S}": r.choice(self.lasts), "{P}": r.choice(self.places), "{T}": r.choice(["Mr", "Mrs", "Dr"]), "{n}": str(r.randint(2, 99)), "{Y}": self.other()}[piece]
                elif not parts and r.random() < 0.5:
                    piece = piece[:1].upper() + piece[1:]
                if own:
                    spans.append((own, at, at + len(piece)))
                parts.append(piece)
                at += len(piece)
            end = r.choice([". ", ". ", " ", "! ", ""])
            parts.append(end or " ")
            at += len(end or " ")
        return "".join(parts), spans


def _examples(texts: int, held: bool, own: Lexicon, w: _Writer) -> tuple[dict[str, np.ndarray], dict[str, np.ndarray]]:
    """Features and labels of the candidates in texts of the writer, by kind."""
    x: dict[str, list] = {k: [] for k in KINDS}
    y: dict[str, list] = {k: [] for k in KINDS}
    for _ in range(texts):
        text, spans = w.text(held)
        for kind, a, b, f in candidates(text, own):
            same = [(s, e) for k, s, e in spans if k == kind]
            hit = any(min(b, e) - max(a, s) >= 0.7 * max(b - a, e - s) for s, e in same)
            if not hit and any(s <= a and b <= e for s, e in same):
                if kind != "address":
                    continue  # a part of a span: neither right nor wrong
                hit = True  # street and number without town or floor
            x[kind].append(f)
            y[kind].append(float(hit))
    return {k: np.array(v, float) for k, v in x.items()}, {k: np.array(v) for k, v in y.items()}


@lru_cache(maxsize=4)
def trained(seed: int, texts: int) -> tuple[dict[str, Boosted], dict[str, float], dict[str, tuple[float, float]]]:
    """Trees, thresholds and held-out (precision, recall) of each kind; fitted once for a seed.

    Trees fitted on texts of the templates for fitting are measured on texts of templates that they
    have never seen; that sets the thresholds. The trees that are used are fitted on both.
    """
    w = _Writer(seed)
    own = Lexicon([], [])
    own.first, own.last = set(map(str.lower, w.firsts[:110])), set(map(str.lower, w.lasts[:150]))
    own._triggers()
    own.common = {x.lower() for t in [*_PLAIN, *_NO_NUMBER.split("|"), *(x for v in _WITH.values() for x in v.split("|"))] for x in _TOKEN.findall(t) if x[0].islower()}
    x, y = _examples(texts - texts // HELD, False, own, w)
    hx, hy = _examples(texts // HELD, True, own, w)
    model, threshold, held_out = {}, {}, {}
    for k in KINDS:
        p, t = Boosted(trees=40).fit(x[k], y[k]).predict(hx[k]), hy[k]
        # the lowest threshold between 0.2 and 0.8 that gives the precision on held-out templates
        fit = [c for c in np.arange(0.2, 0.81, 0.05) if (p >= c).any() and t[p >= c].mean() >= PRECISION]
        threshold[k] = float(fit[0]) if fit else 0.5
        hit = p >= threshold[k]
        held_out[k] = (float(t[hit].mean()) if hit.any() else 1.0, float(hit[t > 0].mean()) if (t > 0).any() else 1.0)
        model[k] = Boosted(trees=40).fit(np.concatenate([x[k], hx[k]]), np.concatenate([y[k], hy[k]]))
    return model, threshold, held_out


class Redactor:
    """Trained trees and thresholds of each kind, with the word lists."""

    def __init__(self, lex: Lexicon, seed: int = 11, texts: int = TEXTS) -> None:
        self.lex = lex
        self.model, self.threshold, self.held_out = trained(seed, texts)

    def find(self, messages: list[str | None]) -> list[list[tuple[int, int, str]]]:
        """Selected spans of each message (offsets in the message itself), in order, not overlapping."""
        proposed: list[tuple[int, str, int, int]] = []
        features: dict[str, list] = {k: [] for k in KINDS}
        where: dict[str, list[int]] = {k: [] for k in KINDS}
        maps: dict[int, list[int]] = {}
        for i, m in enumerate(messages):
            if not m:
                continue
            text, keep = readable(m)
            if keep is not None:
                maps[i] = keep
            for kind, a, b, f in candidates(text, self.lex):
                where[kind].append(len(proposed))
                features[kind].append(f)
                proposed.append((i, kind, a, b))
        score = np.zeros(len(proposed))
        for k in KINDS:
            if features[k]:
                p = self.model[k].predict(np.array(features[k], float))
                score[where[k]] = np.where(p >= self.threshold[k], p, 0)
        found: list[list[tuple[int, int, str]]] = [[] for _ in messages]
        for n in sorted(np.flatnonzero(score), key=lambda n: (proposed[n][0], proposed[n][1] != "email", -round(score[n], 1), proposed[n][2] - proposed[n][3])):
            i, kind, a, b = proposed[n]
            if all(b <= s or a >= e for s, e, _ in found[i]):
                found[i].append((a, b, kind))
        out = []
        for i, spans in enumerate(found):
            keep = maps.get(i)
            out.append(sorted((keep[a], keep[b - 1] + 1, k) if keep else (a, b, k) for a, b, k in spans))
        return out

    def redact(self, message: str | None, spans: list[tuple[int, int, str]]) -> str | None:
        for a, b, k in reversed(spans):
            message = message[:a] + PLACEHOLDER[k] + message[b:]
        return message


def counted(df: DataFrame, column: str, count: Callable[[Iterable[str | None]], tuple[Counter, Counter]]) -> DataFrame:
    """(word, a, b): the two counts of each word over all rows. Counts of a batch are shuffled, no texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = count(batch.column(0).to_pylist())
            words = [*a, *(w for w in b if w not in a)]
            yield pa.RecordBatch.from_pydict({"word": pa.array(words, pa.string()), "a": pa.array([a[w] for w in words], pa.int64()), "b": pa.array([b[w] for w in words], pa.int64())})

    return spread(df.select(column)).mapInArrow(run, "word string, a long, b long").groupBy("word").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))


def lexicon(messages: DataFrame, text: str, names: DataFrame, name: str) -> Lexicon:
    """The word lists of all names and all messages.

    A surname that makes up less than 1/PART of all surnames is left out, first names and common
    words likewise; so each list has at most PART words, and up to PART rows no name is left out.
    """
    known, words = cut(counted(names, name, count_names)), cut(counted(messages, text, count_words))
    n = known.agg(F.sum("a").alias("a"), F.sum("b").alias("b")).first()
    total = words.agg(F.sum("a")).first()[0] or 0
    listed = lambda df: [r["word"] for r in df.select("word").collect()]
    lex = Lexicon([], [])
    lex.fill(
        listed(known.where((F.col("a") > F.col("b")) & (F.col("a") * PART >= F.lit(n["a"] or 0)))),
        listed(known.where((F.col("b") > F.col("a")) & (F.col("b") * PART >= F.lit(n["b"] or 0)))),
        listed(words.where((F.col("a") >= LEAST) & (F.col("b") * 2 >= F.col("a")) & (F.col("a") * PART >= F.lit(total)))),
    )
    return lex


def fitted(messages: DataFrame, text: str, names: DataFrame, name: str) -> Redactor:
    """A redactor whose word lists come from all names and all messages."""
    return Redactor(lexicon(messages, text, names, name))


def details(messages: DataFrame, key: str, text: str, redactor: Redactor) -> DataFrame:
    """(key, redacted, kinds) of every row: the text with placeholders and the kinds found in it.

    Null texts stay null, empty ones empty; repeated rows and null keys come out as they are; long
    texts are read whole; an empty table gives no row. No shuffle; other columns are not read.
    """
    shared = messages.sparkSession.sparkContext.broadcast(redactor)
    kind = messages.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = shared.value
        for b in batches:
            rows = b.column(1).to_pylist()
            spans = r.find(rows)
            redacted = [r.redact(m, s) if s else m for m, s in zip(rows, spans, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(redacted, pa.string()), pa.array([sorted({k for *_, k in s}) for s in spans], pa.list_(pa.string()))], ["key", "redacted", "kinds"])

    return spread(messages.select(key, text)).mapInArrow(run, f"key {kind}, redacted string, kinds array<string>").withColumnRenamed("key", key)


def _details(spark: SparkSession, d: str) -> DataFrame:
    tweets = table(spark, d, "tweet")
    return details(tweets, "id", "message", fitted(tweets, "message", table(spark, d, "author"), "full_name"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return _details(spark, d).where(F.col("id").isNotNull()).select(F.col("id").alias("tweet_id"), F.explode("kinds").alias("kind")).distinct()


def p5_redacted(spark: SparkSession, d: str) -> DataFrame:
    """Every message with typed placeholders in place of personal details."""
    return _details(spark, d).select(F.col("id").alias("tweet_id"), F.col("redacted").alias("message"))


QUERIES = {"p5_found": p5_found, "p5_redacted": p5_redacted}
ORACLES: dict[str, str] = {}
