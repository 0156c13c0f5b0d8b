"""Problem 8: personal information in free text, found by weak supervision.

Wide patterns propose candidate spans of five kinds. For each kind a few
labelers (patterns, gazetteers, context words) vote for, against or abstain.
The patterns of votes are counted over all candidates of all documents, and
expectation-maximisation estimates from the counts how reliable each labeler
is and how likely each pattern of votes is a true case. Those likelihoods
label a bounded sample of candidates, on which a logistic classifier over
votes, shape and neighbouring words is trained; it decides on every
candidate.

Two gazetteers come from the corpus: surnames (words that follow a given
name) and ordinary words (seen in lower case), from counts over all documents
and without a limit to their number. They are files of sorted 64-bit hashes,
eight bytes a word, which the workers of a machine map into memory together.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.scratch import Scratch, write_bytes

KINDS = ("email", "phone", "id_number", "street_address", "person_name")
PLACEHOLDERS = {k: f"[{k.upper()}]" for k in KINDS}

#: Candidates the classifier is trained on at most.
SAMPLE = 20_000
DIMENSIONS = 1 << 14
#: Features of a candidate: six votes, shape, two contexts before, one after, one constant.
FEATURES = 11

# Common given names of several languages.
GIVEN = frozenset(
    """Ahmed Aisha Ali Amélie Amira Ana Andrea Andreas Anna Anne Anne-Sophie Antonio Bram Carlos Carmen Chiara Chloe Clara Daniel David Dmitri Elena Elif Elsa
    Emil Emily Emma Eva Fatima Felix François Frida Giulia Greta Hana Hanna Hans Hassan Helena Henrik Hiroshi Hugo Ibrahim Igor Ines Ingrid Isabel Ivan Jack James
    Jan Jean Jean-Luc Jean-Pierre Joanna Johan John Jonas José Juan Julia Julien Kaito Karim Karl Karl-Heinz Katarina Klara Kofi Lars Laura Lea Leila Lena Leo
    Liam Lin Linda Lisa Lucas Lucía Luis Luisa Łukasz Magdalena Maja Malik Marco Maria María Marie Marie-Claire Mark Marta Martin Mary Mateo Matteo Max Mei Mia
    Michael Mina Miguel Mohamed Nadia Natalia Nina Noah Noor Nora Olga Oliver Olivia Olu Omar Oskar Pablo Patricia Paul Pavel Pedro Peter Petra Pierre Priya
    Rafael Rahul Ravi Robert Rosa Ruth Sam Samuel Sanjay Sara Sarah Sinéad Sofia Sophie Sören Stefan Svetlana Tariq Thomas Tomás Ulrike Viktor Wei William Yuki
    Yusuf Zoë""".split()
)
# Words before a name.
TITLES = frozenset("Mr Mrs Ms Miss Dr Prof Frau Herr Mme M Mlle Sr Sra Don Doña Sir Dame Señor Señora".split())
NAME_BEFORE = re.compile(
    r"(?:thanks to|reported[ -]by|reviewed-by|signed-off-by|co-developed(?: with|-by)|acked-by|tested-by|authors?:|written by|ask|call|on call:|contact:?|as|by|from|cc:?|todo\(|notes \(|\(c\) \d{4}"
    r"|row:|gemeldet von|laut|unter [\d ()/+-]+,|merci à|appeler|signalé par|gracias a|llamar a|informado por|escribir a|lists .{4,40} for|figura|(?:mr|ms|mrs|dr|prof|frau|herr)\.?|and|,)\s*$",
    re.I,
)
NAME_AFTER = re.compile(r"\s?(?:asked|noted|said|wrote|and [A-ZÀ-Þ]|disagree|<|\(?[\w.+-]+@|;|:|, ?\+?\(?\d|\)|hat |ist der|for the|pour la|por la|, not|on [+(\d]|au [+(\d]|al [+(\d])")
NOT_NAME_AFTER = re.compile(r"\s(?:lemma|theorem|condition|cluster|group|team|imports|inequality|conjecture|window|module|corelib|kit|lib|street|st|road|rd|avenue|lane|way|close|terrace|blvd)\b", re.I)

UP = "A-ZÀ-ÖØ-ÞĀĂĄĆČĎĐĒĘĚĞĢĪİĶŁŃŅŇŌŐŘŚŞŠŢŤŪŮŰŹŻŽ"
CAPITAL = re.compile(rf"(?<![\w.@/\-])(?:[{UP}][^\W\d_]+(?:[-’'][{UP}][^\W\d_]+)*|[{UP}]\.)(?![\w@])")
LOWER = re.compile(r"(?<![\w.@/-])[a-zß-ÿ]{3,}(?![\w@])")

EMAIL = re.compile(r"(?<![\w.+@-])[A-Za-z0-9][\w.+-]*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*")
HIDDEN = re.compile(
    r"(?<![\w.+@-])[A-Za-z0-9][\w.+-]*\s?[\[({<]\s?at\s?[\])}>]\s?[A-Za-z0-9-]+(?:\s?(?:[\[({<]\s?dot\s?[\])}>]|\.)\s?[A-Za-z0-9-]+)+"
    r"|(?<![\w.+@-])[A-Za-z0-9][\w.+-]*\s+at\s+[A-Za-z0-9-]+(?:\s+dot\s+[A-Za-z0-9-]+|\.[A-Za-z]{2,}\b)+",
    re.I,
)
#: What any disguised address holds.
AT = re.compile(r"[\[({<]\s?at\s?[\])}>]|\sat\s+[a-z0-9-]+(?:\s+dot\s|\.[a-z]{2,}\b)", re.I)
MAIL_BEFORE = re.compile(r"(?:<|mailto:|contact\"?:? \"?|user=|;|\(|write to|oder|unter|reported.{0,40}|escribir a|cc:?|\")\s*$", re.I)
NOT_MAIL = re.compile(r"(?:pip install|clone|ssh|scp|npm|upstairs|install)\s*[\w./:@-]{0,40}$", re.I)

NUMBER = re.compile(r"(?<![\w.+/\-:])(?:\(?\+\d|\(\d|\d)(?:[ \xa0()./\-]{0,2}\d){7,15}(?!\w)")
# North American numbers; others by their prefix and number of digits
PHONE_FORM = re.compile(r"(?:\+?1[ .-]?)?\(?[2-9]\d\d\)?[ .-]?[2-9]\d\d[ .-]?\d{4}(?!\d)")
PHONE_DIGITS = re.compile(r"\+(?:[2-9]\d{8,13})|00[1-9]\d{9,13}|0[1-9]\d{8,10}")
DATE = re.compile(r"\d{4}-\d\d-\d\d(?!\d)")
ADDRESS_IP = re.compile(r"(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)")
# Ends of host names.
TOP = frozenset("com org net edu gov int mil info biz io dev app ai co uk de fr es it nl eu us ca au nz ie at ch be dk se no fi pl cz pt br mx ar in jp cn kr za test example invalid localhost".split())
PHONE_BEFORE = re.compile(r"(?:tel\.?:?|tel\"?[:=] ?\"?|phone:?|mobile:?|fax:?|call .{0,45} on|number changed, it is|unter|au|al|contact:.{0,60}/|questions:|oder|on call:.{0,45},|;|,)\s*$", re.I)
NOT_PHONE = re.compile(
    r"(?:\brows?|offsets?|range|shape|hash|grp|tok|id=|build|version|latency|serve|ssn|national id|passport.{0,8}|security no\.?|nir|dni|nie|steuer-id\w*\.?|nino:?|number|sociale|wrong,|commit|win=|seed|tokens?|bytes?|line)\s*\S{0,12}$",
    re.I,
)
PHONE_AFTER = re.compile(r"(?:\s*$|\s*[\n\r]|\s?now\b|[.,;\")]|\s+(?:status|cc)\b)")
NOT_PHONE_AFTER = re.compile(r"\s+(?:and|is|are|of|was|differs?|drops|ms|s|bytes)\b")

ID_LABEL = re.compile(
    r"(?:SSN|social security (?:no|number)|national id|national insurance (?:no|number)|NINO|NI number|passport(?: no| number)?|ID card(?: no| number)?|identity (?:card|no|number)|tax id"
    r"|driving licen[cs]e|DNI|NIE|NIF|CURP|Personalausweis(?:nummer)?|Reisepass|Ausweis(?:nummer)?|Steuer-?ID|Steuer-?IdNr|Sozialversicherungsnummer|NIR|n° de sécurité sociale"
    r"|numéro de sécurité sociale|carte d'identité|passeport|pasaporte)\.?\s*:?\s*(?:no\.?|nr\.?|n°|is)?\s*(?P<v>(?=[A-Z\d -]*\d{3}|[A-Z\d -]*\d \d)[A-Z]{0,3}[ -]?\d[A-Z\d]*(?:[ -]?[A-Z\d]*\d[A-Z\d]*)*(?:[ -]?[A-Z]\b)?)",
    re.I,
)
#: One of these is in every label.
ID_WORDS = ("ssn", "security", "national", "nino", "ni number", "passport", "card", "identity", "tax id", "licen", "dni", "nie", "nif", "curp", "ausweis", "reisepass", "steuer", "sozialvers", "nir", "sécurité", "carte", "passeport", "pasaporte")
ID_BARE = re.compile(r"(?<![\w.+/\-])(?P<v>\d{3}-\d{2}-\d{4}|\d{6}-\d{4}|QQ ?\d\d ?\d\d ?\d\d ?[A-D]|[XYZ]-?\d{7}-?[A-Z]|\d{8}-?[A-Z]|QQ\w{6,14})(?![\w-])")
ID_FORM = re.compile(r"\d{3}[- ]\d{2}[- ]\d{4}|\d{6}-\d{4}|[A-Z]{2} ?\d\d ?\d\d ?\d\d ?[A-D]|[XYZ]-?\d{7}-?[A-Z]|\d{8}-?[A-Z]|[A-Z]{1,2}-?\d{6,9}|L\dX\d{5,7}|\d{2} ?\d{3} ?\d{3} ?\d{3}|\d ?\d\d ?\d\d ?\d\d ?\d{3} ?\d{3} ?\d\d")
NOT_ID = re.compile(r"(?:checksum|hash|shape|tok|grp|build|commit|version|rows?|range|wrong,)\s*\S{0,10}$", re.I)

_STREET = "Street|St|Road|Rd|Avenue|Ave|Lane|Ln|Way|Close|Terrace|Blvd|Boulevard|Drive|Court|Ct|Place|Square|Crescent|Row|Walk|Gardens|Mews|Grove|Hill|Parade|Quay"
ADDRESS = re.compile(
    rf"(?<![\w.:/-])(?P<en>\d{{1,4}}[A-Za-z]? (?:[{UP}][\w'-]+ ){{1,3}}?(?:{_STREET})\b\.?)"
    rf"|(?<!\w)(?P<de>(?:(?:Am|An der|Im|Zum) )?[{UP}][\w-]*(?:straße|strasse|str\.|-Str\.|weg|platz|allee|gasse|ring|ufer|damm) \d{{1,4}} ?[a-z]?\b)"
    rf"|(?<![\w.:/-])(?P<fr>\d{{1,4}}(?: (?:bis|ter|quater))?,? (?:rue|avenue|chemin|boulevard|place|allée|impasse|quai|cours|route|square) (?:de la |de l'|du |des |de |d')?[{UP}][\w'-]+)"
    rf"|(?<!\w)(?P<es>(?:Calle|C/|Avda\.?|Avenida|Plaza|Pza\.?|Paseo|Camino) ?(?:de la |de los |del |de )?[{UP}][\w'-]+,? (?:n\.?º ?|núm\. ?)?\d{{1,4}})"
)
ADDRESS_TAIL = re.compile(
    rf"(?:, (?:Apt\.?|Flat|Unit|Suite) ?\d+)?(?:, \dº ?[A-Z])?(?:,? (?:[A-Z]{{1,2}}-)?\d{{4,5}})?(?:(?:,|(?<=\d)) [{UP}][\w'-]+)?(?:,? (?:[A-Z]{{1,2}}\d{{1,2}} \d[A-Z]{{2}}|\d{{4,5}}))?"
)
ADDRESS_BEFORE = re.compile(r"(?:\b(?:to|at|from|near|opposite|visit|address:?)|adresse d'envoi :|versand:|wohnt in|discos a|row: .{3,45},|;|,)\s*$", re.I)
ADDRESS_AFTER = re.compile(r"(?:\s*$|\s*[\n\r]|\s+please\b|,? (?:[A-Z]{1,2}-)?\d{4,5}\b|, (?:Apt|Flat|[" + UP + r"])|[.;)\"]|, \dº)")


def _bare(word: str) -> str:
    """ASCII lower case, as in mail names."""
    word = word.replace("ø", "o").replace("Ł", "L").replace("ł", "l").replace("ß", "ss")
    return unicodedata.normalize("NFKD", word).encode("ascii", "ignore").decode().lower()


_GIVEN_UPPER = frozenset(g.upper() for g in GIVEN)
_GIVEN_BARE = frozenset(_bare(g) for g in GIVEN)


def is_given(word: str) -> bool:
    return word in GIVEN or (len(word) > 2 and word in _GIVEN_UPPER)


def _word_hash(word: str) -> int:
    return xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))


class Words:
    """A set of words as sorted hashes; what was asked lately is remembered."""

    def __init__(self, hashes: np.ndarray):
        self.hashes = memoryview(hashes).cast("B").cast("Q") if len(hashes) else memoryview(b"").cast("Q")
        self.asked: dict[str, bool] = {}

    def __contains__(self, word: str) -> bool:
        known = self.asked.get(word)
        if known is None:
            if len(self.asked) >= 50_000:
                self.asked.clear()
            h = _word_hash(word)
            at = bisect_left(self.hashes, h)
            known = self.asked[word] = at < len(self.hashes) and self.hashes[at] == h
        return known


#: Lists of a gazetteer file: surnames, surnames as in mail names, ordinary words.
LISTS = ("surnames", "bare", "ordinary")


class Gazetteers:
    """The word lists of a file that was sent to all executors; opened where they are first used."""

    def __init__(self, name: str | None):
        self.name = name
        self._lists: dict[str, Words] | None = None

    def __getstate__(self):
        return self.name

    def __setstate__(self, name):
        self.__init__(name)

    def _words(self, which: str) -> Words:
        if self._lists is None:
            if self.name is None:
                parts = [np.empty(0, np.uint64)] * len(LISTS)
            else:
                data = np.memmap(SparkFiles.get(self.name), np.uint64, "r")
                sizes = data[: len(LISTS)].astype(np.int64)
                parts = np.split(data[len(LISTS) :], np.cumsum(sizes)[:-1])
            self._lists = dict(zip(LISTS, map(Words, parts)))
        return self._lists[which]

    @property
    def surnames(self) -> Words:
        return self._words("surnames")

    @property
    def bare(self) -> Words:
        return self._words("bare")

    @property
    def ordinary(self) -> Words:
        return self._words("ordinary")

    def is_surname(self, word: str) -> bool:
        return all(p.capitalize() in self.surnames for p in re.split(r"[-’']", word))


@dataclass(slots=True)
class Span:
    kind: str
    start: int
    end: int
    votes: tuple[int, ...]


def _sign(good: bool, bad: bool) -> int:
    return 1 if good and not bad else -1 if bad and not good else 0


def _emails(text: str, g: Gazetteers) -> Iterator[Span]:
    plain = EMAIL.finditer(text) if "@" in text else ()
    for m in [*plain, *(HIDDEN.finditer(text) if AT.search(text) else ())]:
        before, after = text[max(0, m.start() - 45) : m.start()], text[m.end() : m.end() + 12]
        word = re.split(r"@|\s?[\[({<]\s?at\b|\s+at\s+", m.group(), flags=re.I)
        local, host = word[0], word[-1]
        parts = [_bare(p.rstrip("0123456789")) for p in re.split(r"[._+-]", local) if p]
        person = any(p in _GIVEN_BARE or p in g.bare or p[1:] in g.bare for p in parts)
        ordinary = all(p in g.ordinary for p in parts)
        labels = re.split(r"\.|\bdot\b", host, flags=re.I)
        top = labels[-1].strip(" ])}>([{<").lower()
        named = len(labels) > 1 and (top in TOP or "@" in m.group() and top.isalpha())
        remote = bool(NOT_MAIL.search(before)) or after[:1] == ":" and after[1:2] not in ("", " ", "\n")
        yield Span("email", m.start(), m.end(), (_sign(named, not named), _sign(person, ordinary), _sign(bool(MAIL_BEFORE.search(before)), remote), _sign(local.lower() not in ("git", "runner", "root"), local.lower() in ("git", "runner", "root", "noreply", "bot"))))


def _phones(text: str) -> Iterator[Span]:
    for m in NUMBER.finditer(text):
        value = m.group()
        before, after = text[max(0, m.start() - 64) : m.start()], text[m.end() : m.end() + 12]
        n = sum(c.isdigit() for c in value)
        if DATE.match(value) or ADDRESS_IP.fullmatch(value):
            continue
        flat = re.sub(r"\(0\)", "", value)
        form = bool(PHONE_FORM.fullmatch(value) or PHONE_DIGITS.fullmatch(re.sub(r"[^\d+]", "", flat)))
        other = bool(re.match(r"(?:19|20)\d\d[-./]\d\d?[-./]|(?:\d{1,3}\.){3}\d{1,3}$", value)) and value[0] != "0"
        bad = bool(NOT_PHONE.search(before[-30:]))
        yield Span(
            "phone", m.start(), m.end(),
            (_sign(form and not other, not form or other), _sign(bool(PHONE_BEFORE.search(before)), bad), _sign(bool(PHONE_AFTER.match(after)), bool(NOT_PHONE_AFTER.match(after))), _sign(9 <= n <= 14, n < 9 or n > 14), -1 if bad or ID_BARE.fullmatch(value) else 0),
        )


def _ids(text: str) -> Iterator[Span]:
    seen = set()
    low = text.lower()
    patterns = [(True, ID_LABEL)] if any(w in low for w in ID_WORDS) else []
    for labelled, pattern in (*patterns, (False, ID_BARE)):
        for m in pattern.finditer(text):
            start, end = m.span("v")
            if start in seen:
                continue
            seen.add(start)
            value = m.group("v")
            n = sum(c.isdigit() for c in value)
            bad = bool(NOT_ID.search(text[max(0, start - 24) : start]))
            yield Span("id_number", start, end, (1 if labelled else -1, _sign(bool(ID_FORM.fullmatch(value)), n < 5), -1 if bad else 0, _sign(6 <= n <= 16, n < 6)))


def _addresses(text: str, g: Gazetteers) -> Iterator[Span]:
    for m in ADDRESS.finditer(text):
        form = m.lastgroup
        before, after = text[max(0, m.start() - 56) : m.start()], text[m.end() : m.end() + 16]
        end = m.end()
        if tail := ADDRESS_TAIL.match(text, end):
            end = tail.end()
        words = [w.lower() for w in re.findall(r"[^\W\d_]+", m.group())]
        name = words[:-1] if form == "en" else words[-1:]
        plain = any(w in g.ordinary for w in name)
        follows = bool(ADDRESS_AFTER.match(after))
        yield Span("street_address", m.start(), end, (_sign(follows, bool(re.match(r"\s+[a-z]", after)) and not follows), 1 if ADDRESS_BEFORE.search(before) else 0, _sign(not plain, plain), 1 if form != "en" else 0))


def _names(text: str, g: Gazetteers, locals_: str) -> Iterator[Span]:
    tokens = [(m.start(), m.end(), m.group()) for m in CAPITAL.finditer(text)]
    n, i = len(tokens), 0
    gap = lambda a, b: text[tokens[a][1] : tokens[b][0]]
    while i < n:
        start, end, word = tokens[i]
        step, hit = 1, None
        first = is_given(word)
        if first or word.endswith("."):  # given or initials, then a surname
            j = i + 1
            while j < n and tokens[j][2].endswith(".") and len(tokens[j][2]) == 2 and gap(j - 1, j) in (" ", ""):
                j += 1
            if j < n and gap(j - 1, j) == " " and not tokens[j][2].endswith("."):
                hit, step = (start, tokens[j][1], first, g.is_surname(tokens[j][2])), j - i + 1
        elif i + 1 < n and gap(i, i + 1) == ", " and is_given(tokens[i + 1][2]):
            ahead = i + 2
            while ahead < n and tokens[ahead][2].endswith(".") and gap(ahead - 1, ahead) == " ":
                ahead += 1
            taken = ahead < n and gap(ahead - 1, ahead) == " " and g.is_surname(tokens[ahead][2])
            if g.is_surname(word) or not taken:
                if not (taken and not g.is_surname(word)):
                    hit, step = (start, tokens[i + 1][1], True, g.is_surname(word)), 2
                    if taken:
                        hit, step = None, 1
        turned = i + 2 < n and gap(i + 1, i + 2) == ", " and is_given(tokens[i + 2][2])
        if hit is None and not turned and i + 1 < n and not first and word.rstrip(".") not in TITLES and gap(i, i + 1) == " " and not word.endswith(".") and not is_given(tokens[i + 1][2]) and not tokens[i + 1][2].endswith("."):
            hit, step = (start, tokens[i + 1][1], False, g.is_surname(tokens[i + 1][2])), 2  # two capitals, given name unknown
        if hit is None and not first and g.is_surname(word) and len(word) > 2 and re.search(r"\b(?:Mr|Mrs|Ms|Dr|Prof|Frau|Herr|Mme|Sr|Sra)\.? $", text[max(0, start - 6) : start]):
            hit = (start, end, False, True)
        if hit:
            a, b, given, sur = hit
            before, after = text[max(0, a - 60) : a], text[b : b + 14]
            cue = bool(NAME_BEFORE.search(before))
            wrong = bool(NOT_NAME_AFTER.match(after)) or text[b : b + 1] == "." and text[b + 1 : b + 2].isalpha()
            initial = text[a + 1 : a + 2] == "."
            last = re.split(r"[ ,]+", text[a:b])
            plain = any(w.lower() in g.ordinary for w in last)
            yield Span("person_name", a, b, (0 if initial else 1 if given else -1, 1 if sur else -1, 1 if cue else 0, _sign(bool(NAME_AFTER.match(after)), wrong), -1 if plain or wrong else 0, 1 if _bare(last[0] if "," in text[a:b] else last[-1]) in locals_ else 0))
        i += step


def candidates(text: str, g: Gazetteers) -> list[Span]:
    mails = list(_emails(text, g))
    out = [*mails, *_ids(text), *_phones(text), *_addresses(text, g)]
    locals_ = " ".join(_bare(text[m.start : m.end].split("@")[0]) for m in mails)
    mails.sort(key=lambda m: m.start)
    starts, ends = [m.start for m in mails], []
    for m in mails:  # the farthest end of those so far
        ends.append(max(m.end, ends[-1] if ends else 0))
    for s in _names(text, g, locals_):
        at = bisect_right(starts, s.start)
        if not at or ends[at - 1] <= s.start:
            out.append(s)
    return out


def features(text: str, s: Span) -> list[int]:
    """Hashed features: votes, shape, neighbouring words."""
    value = text[s.start : s.end]
    shape = re.sub(r"(.)\1+", r"\1", "".join("9" if c.isdigit() else "A" if c.isupper() else "a" if c.isalpha() else c for c in value[:24]))
    before = re.findall(r"[^\W\d_]+|[^\w\s]", text[max(0, s.start - 40) : s.start])[-2:]
    after = re.findall(r"[^\W\d_]+|[^\w\s]", text[s.end : s.end + 24])[:1]
    names = [f"v{i}={v}" for i, v in enumerate((*s.votes, 0, 0, 0, 0, 0, 0)[:6])]
    names += [f"s={shape}", f"b={before[-1].lower() if before else ''}", f"bb={' '.join(before).lower()}", f"a={after[0].lower() if after else ''}", "1"]
    return [xxhash.xxh32_intdigest(f"{s.kind}:{x}") % DIMENSIONS for x in names]


def reliabilities(counts: dict[tuple[int, ...], int], rounds: int = 60) -> dict[tuple[int, ...], float]:
    """Likelihood of a true case for each pattern of votes, by expectation-maximisation.

    Starts from the majority of votes; labelers are independent given the
    truth, each with its own chance of every vote in either case. A pattern of
    two or more votes on one side and none on the other isn't turned against
    them: where nearly all candidates are true, or none, the estimate would
    otherwise make up the missing case.
    """
    patterns = list(counts)
    votes = np.array(patterns)
    n = np.array([counts[p] for p in patterns], float)
    good = 1 / (1 + np.exp(-1.5 * votes.sum(1)))
    least = np.where((votes.min(1) >= 0) & (votes.sum(1) >= 2), good, 0.0)
    most = np.where((votes.max(1) <= 0) & (votes.sum(1) <= -2), good, 1.0)
    for _ in range(rounds):
        share = np.clip((n * good).sum() / n.sum(), 0.02, 0.98)
        score = np.full(len(patterns), np.log(share / (1 - share)))
        for j in range(votes.shape[1]):
            for v in (-1, 0, 1):
                at = votes[:, j] == v
                yes = ((n * good)[at].sum() + 0.5) / ((n * good).sum() + 1.5)
                no = ((n * (1 - good))[at].sum() + 0.5) / ((n * (1 - good)).sum() + 1.5)
                step = np.log(yes / no)
                # a vote never counts against what it says
                step = max(step, 0.0) if v > 0 else min(step, 0.0) if v < 0 else step
                score[at] += step
        new = np.clip(1 / (1 + np.exp(-np.clip(score, -30, 30))), least, most)
        if np.abs(new - good).max() < 1e-6:
            break
        good = new
    return dict(zip(patterns, good.tolist()))


def train(rows: list[list[int]], goal: np.ndarray, rounds: int = 300, penalty: float = 1e-4) -> np.ndarray:
    """Weights of a logistic classifier over hashed features with soft labels."""
    w = np.zeros(DIMENSIONS)
    if not rows:
        return w
    size = np.array([len(r) for r in rows])
    flat, owner = np.concatenate([np.array(r) for r in rows]), np.repeat(np.arange(len(rows)), size)
    scale = np.zeros(DIMENSIONS)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(owner, w[flat], minlength=len(rows)), -30, 30)))
        grad = np.bincount(flat, (p - goal)[owner], minlength=DIMENSIONS) / len(rows) + penalty * w
        scale += grad**2
        w -= 0.5 * grad / np.sqrt(scale + 1e-10)
    return w


# ---- over the corpus


def _texts(batch: pa.RecordBatch) -> Iterator[tuple[int, str]]:
    for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
        if text and key is not None:
            yield key, text


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows kind, word, n: lower-case words, capitalised words, and those after a given name."""
    tally: Counter = Counter()

    def flush():
        keys = list(tally)
        out = pa.RecordBatch.from_arrays([pa.array([k for k, _ in keys], pa.string()), pa.array([w for _, w in keys], pa.string()), pa.array([tally[k] for k in keys], pa.int64())], names=["kind", "word", "n"])
        tally.clear()
        return out

    for batch in batches:
        for _, text in _texts(batch):
            tally.update(("lower", w) for w in set(LOWER.findall(text)))
            last, given = 0, False
            for m in CAPITAL.finditer(text):
                word = m.group()
                if word.endswith("."):
                    continue
                gap = text[last : m.start()]
                for part in re.split(r"[-’']", word):
                    if len(part) > 1:
                        part = part.capitalize()
                        tally["seen", part] += 1
                        if given and (gap == " " or re.fullmatch(r" (?:[A-Z]\. ?){1,2}", gap)):
                            tally["after", part] += 1
                last, given = m.end(), is_given(word)
        if len(tally) > 300_000:
            yield flush()
    yield flush()


def _list_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows list, hash of the words of the gazetteers."""
    for batch in batches:
        rows = []
        for word, surname, ordinary in zip(*(batch.column(i).to_pylist() for i in range(3))):
            if surname:
                rows += [(0, _word_hash(word)), (1, _word_hash(_bare(word)))]
            if ordinary:
                rows.append((2, _word_hash(word)))
        which, h = zip(*rows) if rows else ((), ())
        yield pa.RecordBatch.from_arrays([pa.array(which, pa.int32()), pa.array(np.array(h, np.uint64).view(np.int64))], names=["list", "h"])


def gazetteers(texts: DataFrame) -> Gazetteers:
    """From the counts of all texts (columns key, text).

    A surname follows a given name twice or more, and in a fifth of the places
    where it is seen; an ordinary word stands in three texts in lower case.
    """
    spark = texts.sparkSession
    scratch = Scratch(spark)
    rows = texts.mapInArrow(_count_words, "kind string, word string, n bigint")
    total = lambda k: F.sum(F.when(F.col("kind") == k, F.col("n")).otherwise(0)).alias(k)
    counts = rows.groupBy("word").agg(total("lower"), total("seen"), total("after")).where("lower >= 3 or after >= 2")
    chosen = counts.select("word", F.expr("after >= 2 and after * 5 >= seen").alias("surname"), F.expr("lower >= 3").alias("ordinary")).where("surname or ordinary")
    hashes = chosen.mapInArrow(_list_hashes, "list int, h bigint").distinct().toPandas()  # twelve bytes a word, no texts
    lists = [np.sort(hashes.loc[hashes["list"] == i, "h"].to_numpy(np.int64).view(np.uint64)) for i in range(len(LISTS))]
    path = scratch.path("gazetteers") + ".bin"
    write_bytes(spark, path, np.concatenate([np.array([len(x) for x in lists], np.uint64), *lists]).tobytes())
    spark.sparkContext.addFile(path)
    return Gazetteers(path.rsplit("/", 1)[1])


#: A document's candidates: parallel lists, features flat with FEATURES each.
_CANDIDATES = "kind array<string>, start array<bigint>, `end` array<bigint>, votes array<string>, hash array<double>, features array<int>"


def _survey(known) -> Callable:
    """One row per document with candidates: the spans, their votes, a hash for sampling and features."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = known.value
        for batch in batches:
            rows = []
            for key, text in _texts(batch):
                found = candidates(text, g)
                if found:
                    rows.append(
                        (
                            key,
                            [s.kind for s in found],
                            [s.start for s in found],
                            [s.end for s in found],
                            [f"{s.kind}:{','.join(map(str, s.votes))}" for s in found],
                            [xxhash.xxh64_intdigest(f"{key}:{s.kind}:{s.start}") / 2**64 for s in found],
                            [f for s in found for f in features(text, s)],
                        )
                    )
            columns = list(zip(*rows)) if rows else [()] * 7
            types = [batch.schema.types[0], pa.list_(pa.string()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.string()), pa.list_(pa.float64()), pa.list_(pa.int32())]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["key", "kind", "start", "end", "votes", "hash", "features"])

    return run


def _parse(pattern: str) -> tuple[str, tuple[int, ...]]:
    kind, votes = pattern.split(":")
    return kind, tuple(map(int, votes.split(",")))


class Model:
    """Gazetteers and classifier; small, sent to all tasks."""

    def __init__(self, g: Gazetteers, weights: np.ndarray):
        self.g, self.weights = g, weights

    def spans(self, text: str) -> list[Span]:
        """Accepted spans in order."""
        found = candidates(text, self.g)
        return settled(found, [float(self.weights[features(text, s)].sum()) for s in found])


def settled(found: list[Span], scores: list[float]) -> list[Span]:
    """Spans with a positive score; of overlapping ones the likelier stays."""
    out: list[Span] = []
    starts: list[int] = []  # of the accepted spans, which don't overlap
    for _, s in sorted(((c, s) for c, s in zip(scores, found) if c > 0), key=lambda x: (-x[0], x[1].start)):
        at = bisect_left(starts, s.end)
        if not at or out[at - 1].end <= s.start:
            at = bisect_left(starts, s.start)
            starts.insert(at, s.start)
            out.insert(at, s)
    return out


def fitted(documents: DataFrame, key_col: str, text_col: str) -> tuple[Model, DataFrame]:
    """The model from all documents, and the candidates of each."""
    sc = documents.sparkSession.sparkContext
    texts = documents.select(F.col(key_col).alias("key"), F.col(text_col).alias("text"))
    g = gazetteers(texts)
    kind = documents.schema[key_col].dataType.simpleString()
    survey = Scratch(documents.sparkSession).cut(texts.mapInArrow(_survey(sc.broadcast(g)), f"key {kind}, {_CANDIDATES}"), "candidates")
    counts: dict[str, dict] = {k: {} for k in KINDS}
    for r in survey.select(F.explode("votes").alias("pattern")).groupBy("pattern").count().collect():  # at most 3 ** labelers a kind
        kind, votes = _parse(r["pattern"])
        counts[kind][votes] = r["count"]
    likely = {k: reliabilities(c) for k, c in counts.items() if c}
    one = F.expr(f"explode(transform(sequence(0, size(hash) - 1), i -> struct(hash[i] as rank, votes[i] as pattern, slice(features, i * {FEATURES} + 1, {FEATURES}) as features)))")
    picked = survey.select(one.alias("c")).select("c.*").orderBy("rank", "features").limit(SAMPLE)
    rows, goal = [], []
    for r in picked.collect():
        kind, votes = _parse(r["pattern"])
        rows.append(list(r["features"]))
        goal.append(likely[kind][votes])
    return Model(g, train(rows, np.array(goal))), survey


def fit(documents: DataFrame, key_col: str, text_col: str) -> Model:
    """Gazetteers, reliabilities and classifier from all documents."""
    return fitted(documents, key_col, text_col)[0]


_FOUND = "kind string, start_char bigint, end_char bigint"


def _places(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    k, name, start, end = zip(*rows) if rows else ((),) * 4
    return pa.RecordBatch.from_arrays([pa.array(k, kind), pa.array(name, pa.string()), pa.array(start, pa.int64()), pa.array(end, pa.int64())], names=["key", "kind", "start_char", "end_char"])


def _decide(weights) -> Callable:
    """Places from the candidates of documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = weights.value
        for batch in batches:
            rows = []
            keys, kinds, starts, ends, flat = (batch.column(i).to_pylist() for i in (0, 1, 2, 3, 4))
            for key, kind, start, end, f in zip(keys, kinds, starts, ends, flat):
                scores = w[np.array(f).reshape(-1, FEATURES)].sum(1).tolist()
                found = [Span(k, a, b, ()) for k, a, b in zip(kind, start, end)]
                rows += [(key, s.kind, s.start, s.end) for s in settled(found, scores)]
            yield _places(rows, batch.schema.types[0])

    return run


def _find(model) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for batch in batches:
            yield _places([(key, s.kind, s.start, s.end) for key, text in _texts(batch) for s in m.spans(text)], batch.schema.types[0])

    return run


def find(documents: DataFrame, key_col: str, text_col: str = "text", model: Model | None = None) -> DataFrame:
    """Places of personal information: ``key_col, kind, start_char, end_char`` in code points.

    Without a model one is fitted to the documents; their candidates are then
    decided on without reading the texts again. Null and empty texts have no
    places; documents with a null key are left out. Repeated rows give
    repeated places. Other columns are ignored.
    """
    sc = documents.sparkSession.sparkContext
    kind = documents.schema[key_col].dataType.simpleString()
    if model is None:
        model, survey = fitted(documents, key_col, text_col)
        out = survey.select("key", "kind", "start", "end", "features").mapInArrow(_decide(sc.broadcast(model.weights)), f"key {kind}, {_FOUND}")
    else:
        texts = documents.select(F.col(key_col).alias("key"), F.col(text_col).alias("text"))
        out = texts.mapInArrow(_find(sc.broadcast(model)), f"key {kind}, {_FOUND}")
    return out.withColumnRenamed("key", key_col)


def masked(text: str, spans: list[Span]) -> str:
    at, out = 0, []
    for s in spans:
        out += [text[at : s.start], PLACEHOLDERS[s.kind]]
        at = s.end
    return "".join([*out, text[at:]])


def mask(documents: DataFrame, key_col: str, text_col: str = "text", model: Model | None = None) -> DataFrame:
    """``key_col`` and ``masked``: the text with a typed placeholder for each place; null stays null."""
    model = model or fit(documents, key_col, text_col)
    sent = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch in batches:
            texts = [t if not t else masked(t, m.spans(t)) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["key", "masked"])

    kind = documents.schema[key_col].dataType.simpleString()
    return documents.select(F.col(key_col).alias("key"), F.col(text_col).alias("text")).mapInArrow(run, f"key {kind}, masked string").withColumnRenamed("key", key_col)
