"""What a typed organisation name says: its own words, its line of trade, a person's given name."""

from __future__ import annotations

import html
import re
import unicodedata
from functools import lru_cache
from itertools import permutations
from typing import NamedTuple

#: Legal forms (fixed values).
LEGAL = set("inc incorporated ltd limited ltée ltee corp corporation llp lp llc plc gmbh co".split())
#: Words of trades in full (fixed values); shortenings are recognised by rule.
TRADE = """services centre institute technologies consulting systems associates ocean research software digital learning health analytics laboratory seafood environmental
sciences engineering energy management medical devices power distribution security media productions financial robotics data laboratories biotech group logistics solutions
marine aerospace communications manufacturing geomatics international staffing company sons daughters partners applied rural cold climate fisheries mapping holdings industries
construction insurance education foundation university college network studio pharma mining petroleum fishing transport travel design brothers""".split()
#: Shortenings that the rule would miss or mistake (fixed values).
SHORT = {
    "sw": "software", "intl": "international", "int": "international", "internat": "international", "svcs": "services", "srvcs": "services", "serv": "services", "mgmt": "management",
    "mgt": "management", "ctr": "centre", "center": "centre", "grp": "group", "gr": "group", "aero": "aerospace", "tech": "technologies", "med": "medical", "mar": "marine", "sec": "security",
    "res": "research", "rsch": "research", "fin": "financial", "env": "environmental", "enviro": "environmental", "mfg": "manufacturing", "manuf": "manufacturing", "eng": "engineering",
    "engr": "engineering", "engg": "engineering", "comm": "communications", "comms": "communications", "dist": "distribution", "prod": "productions", "prodns": "productions",
    "lab": "laboratories", "labs": "laboratories", "sys": "systems", "sol": "solutions", "soln": "solutions", "solns": "solutions", "log": "logistics", "inst": "institute", "instit": "institute",
    "assoc": "associates", "assocs": "associates", "sci": "sciences", "ocn": "ocean", "lrng": "learning", "cnslt": "consulting", "bros": "brothers", "laboratory": "laboratories",
}
#: Given names with their short forms (fixed values).
GIVEN = {
    "alexander": "alex al sandy xander", "charles": "charlie chuck chas", "edward": "ed eddie ned ted edw", "eleanor": "ellie nell nora ella", "elizabeth": "liz beth betty eliza lizzie eliz",
    "james": "jim jimmy jamie jas", "joseph": "joe joey jos", "katherine": "kate kathy katie kath kat", "margaret": "maggie meg peggy marge marg", "michael": "mike mick mickey mich",
    "patrick": "pat paddy rick", "richard": "rich dick rick ricky", "robert": "bob rob bobby robt bert", "susan": "sue susie suzy", "theodore": "ted theo teddy", "william": "bill will billy wm liam",
    "thomas": "tom tommy thos", "john": "jack johnny jno", "george": "geo", "david": "dave", "daniel": "dan danny", "andrew": "andy drew", "anthony": "tony", "christopher": "chris",
    "jennifer": "jen jenny", "catherine": "cathy cate", "mary": "molly", "samuel": "sam", "henry": "harry hal", "benjamin": "ben",
}
#: Strings that name nobody, and words of job titles (fixed values).
NOBODY = set("unknown|confidential|confidential employer|n/a|na|none|null|tbd|anonymous|undisclosed|not disclosed|private|various|company|employer|client|our client|unnamed|withheld|company confidential|nan|inconnu|confidentiel|-".split("|"))
TITLE = set(
    """engineer analyst developer designer clerk manager advisor writer specialist researcher technician administrator coordinator inspector architect agent trainer hydrographer generalist
executive steward editor examiner guide analyste développeur développeuse chargée chargé conseillère conseiller commis technicienne technicien magasinier ingénieure ingénieur administratrice cheffe
junior senior sr intermediate principal lead hybrid remote contract""".split()
)
#: Trade words that name a person at the end of a job title (fixed values).
PERSONS = {"associate"}
_ROMAN = re.compile("i{1,3}|iv|v")
_STOP = set("the of for and de des du la le les et und & + a an".split())
_SHORT_OF = {s: full for full, shorts in GIVEN.items() for s in shorts.split()}
_TRADE = set(TRADE)
_WORD = re.compile(r"[^\W_]+(?:['’](?!s\b)[^\W_]+)*\.?")


def fold(text: str) -> str:
    """Lower case without marks, odd spaces and entities."""
    text = unicodedata.normalize("NFKD", html.unescape(text))
    return " ".join("".join(c for c in text if not unicodedata.combining(c)).lower().split())


_TITLE, _LEGAL = {fold(w) for w in TITLE}, {fold(w) for w in LEGAL}


def edits(a: str, b: str, most: int) -> int:
    """Edit distance with exchanges of neighbours (optimal string alignment), at most ``most + 1``."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) > most:
        return most + 1
    before, row = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            d = min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, before[j - 2] + 1)
            new.append(d)
        if min(new) > most:
            return most + 1
        before, row = row, new
    return min(row[-1], most + 1)


@lru_cache(maxsize=100_000)
def trade_word(word: str, dotted: bool) -> str | None:
    """The trade word that ``word`` is: in full, shortened, or mistyped; else None."""
    if word in SHORT:
        return SHORT[word]
    if word in _TRADE:
        return word
    if len(word) >= 5:
        most = 1 if len(word) < 8 else 2
        near = sorted((d, t) for t in TRADE if t[0] == word[0] or len(word) > 6 if (d := edits(word, t, most)) <= most)
        if near:
            return SHORT.get(near[0][1], near[0][1])
    if len(word) >= 4:
        # the beginning of one, or its beginning and its last letter: "softw", "fincl"
        for t in TRADE:
            it = iter(t)
            if len(word) < len(t) and (t.startswith(word) or t[:3] == word[:3] and t[-1] == word[-1] and all(c in it for c in word)):
                return SHORT.get(t, t)
    if dotted and len(word) >= 2 or len(word) <= 6 and not re.search("[aeiouy]", word[1:-1]) and len(word) >= 3:
        # a beginning, or consonants in their order: "softw.", "fincl", "medl"
        for t in TRADE:
            it = iter(t)
            if t[0] == word[0] and len(word) < len(t) and (t.startswith(word) or len(word) >= 3 and word[:2] == t[:2] and all(c in it for c in word)):
                return SHORT.get(t, t)
    return None


class Name(NamedTuple):
    core: tuple[str, ...]  #: the organisation's own words, in their order
    given: str  #: a person's given name in full, an initial, or nothing
    trade: tuple[str, ...]  #: trade words in full, sorted

    @property
    def compact(self) -> str:
        return "".join(self.core)


def parse(name: str, places: frozenset[str] = frozenset()) -> Name | None:
    """The parts of ``name``; None if it names no organisation. ``places`` are folded names of towns."""
    whole = re.sub(r"\bl\.?l\.?p\b\.?", "llp", fold(name))
    whole = re.sub(r"\(\s*formerly\b[^)]*\)", " ", whole)
    if not whole or whole.strip(" .-") in NOBODY:
        return None
    caps = {m.lower() for m in re.findall(r"\b[A-Z]{2,6}\b", name)} if not name.isupper() else set()
    initials = {m.lower() for m in re.findall(r"\(([A-Za-z]{2,6})\)\s*$", name)}
    parts = [p for p in re.split(r"\s[-–—/|]\s|[,;()]|\s/|/\s", whole) if p.strip()]
    kept = []
    for p in parts:
        bare = p.strip(" .'\"*")
        if len(parts) > 1 and (bare in places or bare in initials or bare in caps and bare not in SHORT and bare not in _LEGAL and bare not in _TRADE and " " not in bare):
            continue
        kept.append(p)
    words = [w for p in kept for w in _WORD.findall(p)]
    plain = [re.sub(r"['’]", "", w.rstrip(".")) for w in words]
    titled = _is_title(kept, plain)
    if titled and any(own and own[-1] in PERSONS and all(w in _TITLE or w in _STOP or trade_word(w, False) for w in own) for own in (re.findall(r"[^\W_]+", p) for p in kept)):
        return None
    core, trade, given = [], [], ""
    for raw, w in zip(words, plain):
        if w in _LEGAL or w in _STOP or not w:
            continue
        if w in _TITLE and titled:
            return None
        if w not in _TITLE and (t := trade_word(w, raw.endswith("."))) is not None:
            trade.append(t)
        elif not given and (w in GIVEN or w in _SHORT_OF):
            given = w if w in GIVEN else _SHORT_OF[w]
        elif not given and len(w) == 1:
            given = w
        elif len(w) > 1:
            core.append(w)
    if not core and (len(trade) > 1 or trade and any(w in _LEGAL for w in plain)):
        core, trade = trade, []  # named by its trades alone
    if not core and not trade:
        return None
    return Name(tuple(core), given, tuple(sorted(set(trade))))


def _is_title(parts: list[str], plain: list[str]) -> bool:
    """Whether words of job titles in a name make it one: not with a legal form, nor in front of a trade that no part's last word denies."""
    if any(w in _LEGAL for w in plain):
        return False
    last = [[re.sub(r"['’]", "", w.rstrip(".")) for w in _WORD.findall(p)] for p in parts]
    last = [[w for w in own if not _ROMAN.fullmatch(w)] for own in last]
    last = [own for own in last if own]
    if not last or any(own[-1] in _TITLE or own[-1] in PERSONS for own in last):
        return True
    return trade_word(last[0][-1], False) is None


def same_given(a: str, b: str) -> bool:
    """Whether two given names can be one person's; a missing one or a fitting initial can."""
    return not a or not b or a == b or (1 in (len(a), len(b)) and a[0] == b[0]) or a in _either(b) or b in _either(a)


@lru_cache(maxsize=1_000)
def _either(full: str) -> frozenset[str]:
    """Other full names that a short form of ``full`` can stand for (Ted is Edward or Theodore)."""
    own = set(GIVEN.get(full, "").split())
    return frozenset(x for x, shorts in GIVEN.items() if own & set(shorts.split()))


def allowed(length: int) -> int:
    """Typing errors that two spellings of so many letters may differ by."""
    return 0 if length < 5 else 1 if length < 8 else 2 if length < 18 else 3


def orders(core: tuple[str, ...]) -> list[str]:
    """The words written together: in every order up to three, beyond as they stand, turned by one, and sorted."""
    if len(core) <= 3:
        return ["".join(p) for p in permutations(core)]
    return list(dict.fromkeys("".join(c) for c in (core, core[1:] + core[:1], core[-1:] + core[:-1], sorted(core))))


def _close(x: str, y: str) -> bool:
    most = allowed(min(len(x), len(y)))
    return edits(x, y, most) <= most


def _same_words(a: tuple[str, ...], b: tuple[str, ...]) -> bool:
    """Whether the words of both sides pair off, in any order, with no more errors than the whole may have."""
    if len(a) != len(b):
        return False
    left = allowed(min(sum(map(len, a)), sum(map(len, b))))
    rest = list(b)
    for d, w, v in sorted((edits(w, v, left), i, v) for i, w in enumerate(a) for v in set(b)):
        if d > left:
            break
        if a[w] is not None and v in rest:
            rest.remove(v)
            a = (*a[:w], None, *a[w + 1 :])
            left -= d
    return not rest


def same_core(a: tuple[str, ...], b: tuple[str, ...]) -> bool:
    """Whether two sequences of own words are spellings of one: joined, split, reordered or mistyped words."""
    x, y = "".join(a), "".join(b)
    if any(_close(x, o) for o in orders(b)) or any(_close(y, o) for o in orders(a)[1:]):
        return True
    return max(len(a), len(b)) > 3 and _same_words(a, b)
