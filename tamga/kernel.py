"""Words to written units and back: the semantics of one word, used by the column functions.

A word is looked at once: `Word` has for every token what rules may ask about its surroundings, none of which
depends on conditions. Rules then are small functions from a token to its condition.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

from tamga.tables import BOWED, FVS_NUMBER, LETTER_CLASS, MAX_RECORDS, MVS, NIRUGU, NNBSP, POSITIONS, RULES, SAME_FINA_MEDI, SAME_INIT_MEDI, SAME_ISOL_FINA, SAME_ISOL_INIT, STRUCTURAL, WORD_CLASS, ZWJ, ZWNJ, catalogue

_NOT_WORD = re.compile(f"[^{WORD_CLASS}]")
_RUNS = re.compile(f"([{WORD_CLASS}]+)|[^{WORD_CLASS}]+")
_TOKEN = re.compile("([^\u180b\u180c\u180d\u180f])([\u180b\u180c\u180d\u180f]*)")
_IS_LETTER = re.compile(f"[{LETTER_CLASS}]")
_UNIT_OF = {MVS: "Mvs", NNBSP: "Mvs", NIRUGU: "Nirugu", ZWJ: "Zwj", ZWNJ: "Zwnj"}
_CHAR_OF = dict(STRUCTURAL)
JOINERS = frozenset(("Nirugu", "Zwj"))


class WordError(ValueError):
    """An input that has no result: error_class, message, and where it applies the index and units."""

    def __init__(self, error_class: str, message: str, index: int | None = None, units: tuple[str, ...] = ()):
        super().__init__(message)
        self.error_class, self.index, self.units = error_class, index, units


class NormalizationFallback(WordError):
    """A word without canonical spelling: its text, and the units that have none."""

    def __init__(self, text: str, units: tuple[str, ...]):
        super().__init__("NormalizationFallback", f"normalization fallback: no canonical encoding for written units {'+'.join(units)}", None, units)
        self.text, self.written_units = text, units


def _shown(text: str) -> str:
    return repr(text)[1:-1] if text.isascii() or not text.isprintable() else text


def check_word(word: str) -> None:
    if found := _NOT_WORD.search(word):
        c = found[0]
        raise WordError(
            "NonMongolianChar",
            f"non-Mongolian character '{_shown(c)}' (U+{ord(c):04X}) at index {found.start()}: shape() / normalize() accept only Mongolian letters + "
            "FVS/MVS/NNBSP/Nirugu/ZWJ/ZWNJ. For mixed-script input use normalize_text().",
            found.start(),
        )


_PLACES = {(True, True): "medi", (False, True): "init", (True, False): "fina", (False, False): "isol"}


@lru_cache(512)  # the characters of words are few
def _kind_of(c: str) -> str:
    return "L" if _IS_LETTER.match(c) else "M" if c == MVS else "Z" if c == ZWNJ else "J"


class Word:
    """Tokens of a word and their surroundings. Places that don't exist are None."""

    def __init__(self, text: str):
        check_word(text)
        pairs = _TOKEN.findall(text.lstrip("\u180b\u180c\u180d\u180f"))
        self.n = n = len(pairs)
        self.char = [MVS if c == NNBSP else c for c, _ in pairs]
        self.fvs = [[FVS_NUMBER[f] for f in run] for _, run in pairs]
        #: L letter, M MVS, J nirugu or ZWJ, Z ZWNJ
        self.kind = kind = "".join(map(_kind_of, self.char))
        self.alias = list(map(catalogue().alias.get, self.char))
        joins = [False, *(k in "LJ" for k in kind), False]
        self.position = [_PLACES[a, b] if k == "L" else "isol" for a, b, k in zip(joins, joins[2:], kind, strict=False)]
        # runs of joiners and breaks beside each token: where they begin and end
        self.left, self.right = [0] * n, [n] * n
        if "J" not in kind and "Z" not in kind:
            self.left, self.right = list(range(n)), list(range(1, n + 1))
            return
        for i in range(1, n):
            self.left[i] = self.left[i - 1] if kind[i - 1] in "JZ" else i
        for i in range(n - 2, -1, -1):
            self.right[i] = self.right[i + 1] if kind[i + 1] in "JZ" else i + 1

    # tokens around i ---------------------------------------------------------------------------------------------
    def prev_letter(self, i: int) -> int | None:
        at = self.left[i] - 1
        return at if at >= 0 and self.kind[at] == "L" else None

    def next_letter(self, i: int) -> int | None:
        at = self.right[i]
        return at if at < self.n and self.kind[at] == "L" else None

    def prev_over_break(self, i: int) -> int | None:
        at = self.left[i] - 1 if "Z" in self.kind[self.left[i] : i] else i - 1
        return at if at >= 0 else None

    def next_over_break(self, i: int) -> int | None:
        at = self.right[i] if "Z" in self.kind[i + 1 : self.right[i]] else i + 1
        return at if at < self.n else None

    def onset_vowel(self, mvs: int) -> int | None:
        """The letter after an MVS."""
        at = self.next_over_break(mvs)
        return at if at is not None and self.kind[at] == "L" else None

    def broken_between(self, a: int, b: int) -> bool:
        return "Z" in self.kind[a + 1 : b]

    # FVS around i ------------------------------------------------------------------------------------------------
    def fvs_from(self, i: int) -> bool:
        """An FVS on i or on the run after it."""
        return any(self.fvs[i : self.right[i]])

    def fvs_before(self, i: int) -> bool:
        """The nearest FVS before i is on the run there, or on a letter that the run touches."""
        for at in range(i - 1, self.left[i] - 2, -1):
            if at >= 0 and self.fvs[at]:
                return self.kind[at] != "M"
        return False

    def only_fvs(self, a: int, b: int) -> int | None:
        """The FVS in a to b if there is just one."""
        found = [f for run in self.fvs[a:b] for f in run]
        return found[0] if len(found) == 1 else None

    def selected(self, i: int) -> tuple[str, ...] | None:
        """The units that the token's first FVS selects, if it selects any."""
        return catalogue().variant.get((self.alias[i], self.position[i], self.fvs[i][0])) if self.kind[i] == "L" and self.fvs[i] else None


def _contextual(w: Word, i: int, conditions: list) -> tuple[str, ...]:
    c, a, p = catalogue(), w.alias[i], w.position[i]
    return (c.conditional.get((a, p, conditions[i])) if conditions[i] else None) or c.default.get((a, p), ())


def _written(w: Word, i: int, conditions: list) -> tuple[str, ...]:
    return w.selected(i) or _contextual(w, i, conditions)


# Rules: (word, place, conditions so far) -> the new condition, "" to clear it, None to leave it -------------------
_RULES: dict[str, tuple[frozenset[str], bool, Callable]] = {}
ROUNDED = frozenset(("o", "u", "oe", "ue"))


def _rule(name: str, letters, keeps: bool = True):
    """Register a rule for some letters. keeps: a token that has a condition already keeps it."""

    def add(f: Callable) -> Callable:
        _RULES[name] = (frozenset(letters), keeps, f)
        return f

    return add


@_rule(RULES[0], "ae", keeps=False)
def _chachlag(w: Word, i: int, cond: list) -> str | None:
    p = w.prev_over_break(i)
    if p is not None and w.kind[p] == "M" and (p == i - 1 or w.position[i] == "isol"):
        return "chachlag"


@_rule(RULES[1], ROUNDED)
def _marked(w: Word, i: int, cond: list) -> str | None:
    p = w.prev_letter(i)
    if p is not None and w.alias[p] in catalogue().consonants and w.position[p] == "init":
        return "marked"


@_rule(RULES[2], ROUNDED, keeps=False)
def _unmarked(w: Word, i: int, cond: list) -> str | None:
    if cond[i] == "marked" and (w.fvs_from(i) or w.position[i] == "fina" and w.fvs_before(i)):
        return ""


@_rule(RULES[3], ("oe", "ue"))
def _marked_by_selector(w: Word, i: int, cond: list) -> str | None:
    p = w.prev_letter(i)
    if w.position[i] == "fina" and p is not None and w.alias[p] in ("h", "g") and w.position[p] == "init":
        if w.only_fvs(p, i) in (2, 4) or w.fvs[p][:1] in ([2], [4]):
            return "marked"


@_rule(RULES[4], ROUNDED)
def _cluster(w: Word, i: int, cond: list) -> str | None:
    if w.position[i] != "medi" or w.fvs_from(i):
        return None
    inner, p = False, w.prev_letter(i)
    while p is not None and w.alias[p] in catalogue().consonants and w.position[p] != "isol":
        if w.position[p] == "init":
            return "marked" if inner else None
        inner, p = True, w.prev_letter(p)
    return None


@_rule(RULES[5], "d")
def _d_marked(w: Word, i: int, cond: list) -> str | None:
    v = w.next_letter(i)
    if w.position[i] == "init" and v is not None and w.alias[v] in catalogue().vowels and w.position[v] == "fina":
        between = sum(map(len, w.fvs[i:v]))
        if between > 1 or between == 0 and not w.fvs_from(v):
            return "marked"


@_rule(RULES[6], "njwhg")
def _chachlag_onset(w: Word, i: int, cond: list) -> str | None:
    m = w.next_over_break(i)
    if w.selected(i) or m is None or w.kind[m] != "M":
        return None
    v = w.onset_vowel(m)
    if v is None or w.position[v] != "isol" or w.fvs_from(v) and not any(w.fvs[m:v]):
        return None
    pair = w.alias[i], w.alias[v]
    if pair == ("g", "e"):
        return "chachlag_onset_gb"
    if pair[1] == "a" or pair[1] == "e" and pair[0] in "njw":
        return "chachlag_onset"


@_rule(RULES[7], "ntd")
def _onset_devsger(w: Word, i: int, cond: list) -> str | None:
    v, p, vowels = w.next_letter(i), w.prev_letter(i), catalogue().vowels
    if v is not None and w.alias[v] in vowels and (w.alias[i], w.alias[v]) != ("t", "ee"):
        return "onset"
    if not (w.position[i] == "medi" and v is None) and p is not None and w.alias[p] in vowels:
        return "devsger"


@_rule(RULES[8], "hg")
def _harmony(w: Word, i: int, cond: list) -> str | None:
    c = catalogue()
    if w.selected(i) or _before_chachlag(w, i):
        return None
    v, p = w.next_letter(i), w.prev_letter(i)
    after, before = (None if x is None else w.alias[x] for x in (v, p))
    joined = w.position[i] in ("medi", "fina")
    if after in c.masculine:
        return "masculine_onset"
    if after in c.feminine or after in c.neuter:
        return "feminine"
    if before in c.masculine and joined:
        return "masculine_devsger"
    if before in c.feminine:
        return "feminine"
    if before == "i":
        if joined and _masculine_reaches(w, i):
            return "masculine_devsger"
        if w.alias[i] == "g":
            return "feminine"
    if w.position[i] == "init" and after in c.consonants:
        return "feminine"


def _before_chachlag(w: Word, i: int) -> bool:
    m = w.right[i]
    if m >= w.n or w.kind[m] != "M":
        return False
    v = w.onset_vowel(m)
    return v is not None and w.alias[v] in ("a", "e") and w.position[v] == "isol"


def _masculine_reaches(w: Word, i: int) -> bool:
    """Whether masculine marking reaches an h or g: from the nearest gendered vowel before it, else from behind."""
    c = catalogue()
    p = i
    while True:
        # a run may be crossed only onto a letter that is joined before it
        if w.left[p] < p and w.position[p] not in ("medi", "fina"):
            break
        p = w.prev_letter(p)
        if p is None:
            break
        if w.alias[p] in c.feminine or w.alias[p] in c.masculine:
            if w.position[p] in ("init", "medi"):
                return w.alias[p] in c.masculine
            break
    if w.position[i] == "isol":
        return False
    q = w.next_letter(i)
    while q is not None:
        if w.alias[q] in c.masculine and w.position[q] in ("medi", "fina"):
            return True
        if w.alias[q] in c.feminine or w.position[q] == "isol":
            return False
        if w.position[q] == "fina" and w.right[q] < w.n and w.kind[w.right[q]] == "M":
            v = w.next_over_break(w.right[q])
            return v is not None and w.alias[v] == "a" and w.position[v] == "isol"
        q = w.next_letter(q)
    return False


@_rule(RULES[9], "t")
def _t_devsger(w: Word, i: int, cond: list) -> str | None:
    v = w.next_letter(i)
    if not w.selected(i) and v is not None and (w.alias[v] == "ee" or w.alias[v] in catalogue().consonants):
        return "devsger"


@_rule(RULES[10], ("sh",))
def _sh_dotless(w: Word, i: int, cond: list) -> str | None:
    v = w.next_letter(i)
    if w.selected(i) or v is None or w.alias[v] != "i":
        return None
    if w.position[i] == "init":
        return "dotless" if w.position[v] == "medi" else None
    apart = w.position[v] in ("init", "isol") and w.broken_between(i, v)
    return "dotless" if w.position[i] == "medi" and not apart else None


@_rule(RULES[11], "g", keeps=False)
def _g_dotless(w: Word, i: int, cond: list) -> str | None:
    p, v = w.prev_letter(i), w.next_letter(i)
    if w.selected(i) or p is None or w.alias[p] not in ("s", "d"):
        return None
    if w.position[i] == w.position[p] == "medi" and v is not None and w.alias[v] in catalogue().masculine:
        return "dotless"
    m = w.next_over_break(i) if w.position[i] == "fina" else None
    if m is not None and w.kind[m] == "M":
        a = w.onset_vowel(m)
        if a is not None and w.alias[a] == "a" and w.position[a] == "isol" and cond[a] == "chachlag":
            return "dotless"


def _particle_chains(w: Word) -> Iterator[list[int]]:
    """Places of MVS and letters, cut before each MVS and at the ends of joined chains."""
    chain: list[int] = []
    for i, k in enumerate(w.kind):
        if k not in "ML":
            continue
        opens = k == "M" or w.position[i] in ("init", "isol") and any(w.kind[j] == "L" for j in chain)
        if opens and chain:
            yield chain
            chain = []
        chain.append(i)
        if k == "L" and w.position[i] in ("fina", "isol"):
            yield chain
            chain = []
    if chain:
        yield chain


_BARE_PARTICLES = [[k[0]] for k in catalogue().particles if k[0] != "mvs"]


def _particles(w: Word) -> dict[int, str]:
    found: dict[int, str] = {}
    known = catalogue().particles
    if "M" not in w.kind and w.alias[:1] not in _BARE_PARTICLES and "Z" not in w.kind:
        return found  # only chains that start so can be particles without an MVS
    for chain in _particle_chains(w):
        names = tuple("mvs" if w.kind[i] == "M" else w.alias[i] or "?" for i in chain)
        if names not in known and names[0] == "mvs":
            chain, names = chain[1:], names[1:]
        places = known.get(names)
        if not places or any(w.fvs[chain[0] : w.right[chain[-1]]]):
            continue
        letters = [w.position[i] for i in chain if w.kind[i] == "L"]
        if letters != (["isol"] if len(letters) == 1 else ["init", *["medi"] * (len(letters) - 2), "fina"]):
            continue
        found |= {chain[k]: "particle" for k in places if w.alias[chain[k]] in ("a", "e", "i", "u", "ue", "d", "y")}
    return found


#: (letter, position, the one FVS before an i) -> whether the i is doubled.
_BY_SELECTOR = {("medi", 3): True, ("medi", 1): False, ("medi", 2): False}
_BY_SELECTOR_UE_INIT = {1: True, 2: False}


@_rule(RULES[13], "i")
def _vowel_devsger(w: Word, i: int, cond: list) -> str | None:
    p = w.prev_letter(i)
    if w.position[i] != "medi" or w.selected(i) or p is None or w.alias[p] not in catalogue().vowels:
        return None
    if w.position[p] in ("fina", "isol") and w.broken_between(p, i):
        return None
    if w.alias[p] in ("oe", "ue") and (f := w.only_fvs(p, i)) is not None:
        doubled = _BY_SELECTOR_UE_INIT.get(f) if (w.alias[p], w.position[p]) == ("ue", "init") else _BY_SELECTOR.get((w.position[p], f))
        if doubled is not None:
            return "vowel_devsger" if doubled else None
    return None if _contextual(w, p, cond)[-1:] == ("I",) else "vowel_devsger"


@_rule(RULES[14], (*ROUNDED, "a", "e"), keeps=False)
def _post_bowed(w: Word, i: int, cond: list) -> str | None:
    p = w.prev_letter(i)
    if cond[i] == "marked" or w.position[i] != "fina" or p is None:
        return None
    open_before = w.position[p] in ("init", "medi")
    form = _written(w, p, cond) if open_before else _contextual(w, p, cond)
    velar, other = form in (("G",), ("Gx",)), form[-1:] in (("B",), ("P",), ("F",), ("K",), ("K2",))
    if not (velar or other) or velar and w.alias[i] == "a":
        return None
    if first := w.fvs[p][:1]:
        if velar and w.alias[p] in ("g", "h"):
            if first[0] in (1, 3) or open_before and first[0] in (2, 4) and w.alias[i] in ("o", "u"):
                return None
        if other and w.position[p] == "init" and w.alias[i] in ("oe", "ue"):
            return "marked"
    return "post_bowed"


def run_rules(w: Word) -> Iterator[tuple[str, list]]:
    """(rule, conditions after it) for each rule in order."""
    cond: list[str | None] = [None] * w.n
    present = set(w.alias)
    for name in RULES:
        if name == "III.3.particle":
            for i, c in _particles(w).items():
                cond[i] = c
        else:
            letters, keeps, rule = _RULES[name]
            if not letters.isdisjoint(present):
                for i, a in enumerate(w.alias):
                    if a in letters and not (keeps and cond[i]) and (new := rule(w, i, cond)) is not None:
                        cond[i] = new or None
        yield name, cond


def conditions(w: Word) -> list[str | None]:
    for _, cond in run_rules(w):
        pass
    return cond


def written_by_token(w: Word, cond: list) -> list[tuple[str, ...]]:
    return [_written(w, i, cond) if w.kind[i] == "L" else () for i in range(w.n)]


def _raw(w: Word, forms: list[tuple[str, ...]]) -> tuple[str, ...]:
    return tuple(u for i, form in enumerate(forms) for u in ((_UNIT_OF[w.char[i]],) if w.kind[i] != "L" else form))


# Unit sequences ---------------------------------------------------------------------------------------------------
def place_of(start: int, length: int, total: int) -> str:
    """The position of some units in a chain."""
    return ("isol" if start + length == total else "init") if start == 0 else "fina" if start + length == total else "medi"


def _chains(units: tuple[str, ...]) -> Iterator[tuple[tuple[str, ...], int, int]]:
    """(units, joined before, joined after): chains; a structural unit comes alone, with -1."""
    start = 0
    while start < len(units):
        end = start
        while end < len(units) and units[end] not in STRUCTURAL:
            end += 1
        if end == start:
            yield units[start : start + 1], -1, -1
            start += 1
        else:
            yield units[start:end], int(start > 0 and units[start - 1] in JOINERS), int(end < len(units) and units[end] in JOINERS)
            start = end


_DOUBLE = frozenset(("Dd", "Cr", "H", "Hx"))


def expand(units: tuple[str, ...]) -> tuple[str, ...]:
    """Units that look like two others are written as these."""
    if _DOUBLE.isdisjoint(units):
        return units
    out: list[str] = []
    for chain, before, after in _chains(units):
        for i, u in enumerate(chain):
            inner = before >= 0 and place_of(i + before, 1, len(chain) + before + after) == "medi"
            out += {"Dd": ("O", "A"), "Cr": ("O", "O")}.get(u) or (({"H": ("A", "A"), "Hx": ("N", "N")}.get(u) or (u,)) if inner else (u,))
    return tuple(out)


def contract(units: tuple[str, ...]) -> tuple[str, ...]:
    """A chain's last two units become one if they look like it."""
    if "Aa" not in units:
        return units
    out: list[str] = []
    for chain, before, after in _chains(units):
        if len(chain) > 1 and chain[-1] == "Aa" and before >= 0:
            place = place_of(len(chain) - 2 + before, 1, len(chain) - 1 + before + after)
            bowed = len(chain) > 2 and chain[-3] in BOWED
            one = {("A", "isol"): "A", ("A", "fina"): "Aa" if bowed else None, ("O", "fina"): "B2", ("I", "fina"): "G"}.get((chain[-2], place))
            chain = (*chain[:-2], one) if one else chain
        out += chain
    return tuple(out)


_ALONE_FIRST, _FIRST = frozenset(SAME_ISOL_FINA.split()), frozenset(SAME_INIT_MEDI.split())
_ALONE_LAST, _LAST = frozenset(SAME_ISOL_INIT.split()), frozenset(SAME_FINA_MEDI.split())
_EDGE = (None, "Mvs", "Zwnj")


def _joiner_is_idle(units: list[str], i: int) -> bool:
    at = lambda k: units[k] if 0 <= k < len(units) else None
    before, after = at(i - 1), at(i + 1)
    if before is None and after is None:
        return False
    if "Nirugu" in (before, after):
        return True
    inside_left, inside_right = before not in _EDGE and before != "Zwj", after not in _EDGE and after != "Zwj"
    if before in _EDGE and inside_right:
        return after in (_ALONE_FIRST if at(i + 2) in _EDGE else _FIRST)
    if inside_left and after in _EDGE:
        return before in (_ALONE_LAST if at(i - 2) in _EDGE else _LAST)
    return True


def _break_is_idle(units: list[str], i: int) -> bool:
    at = lambda k: units[k] if 0 <= k < len(units) else None
    if len(units) == 1:
        return False
    left, right, alike = at(i - 1), at(i + 1), catalogue().alike
    if "Mvs" in (left, right):
        return True
    joins = lambda u: int(u is not None and u not in ("Mvs", "Zwnj"))
    where = lambda a, b: place_of(joins(a), 1, joins(a) + 1 + joins(b))
    same = lambda u, p, q: p == q or (u, p, q) in alike
    if left is not None and left not in STRUCTURAL and not same(left, where(at(i - 2), "Zwnj"), where(at(i - 2), right)):
        return False
    return not (right is not None and right not in STRUCTURAL and not same(right, where("Zwnj", at(i + 2)), where(left, at(i + 2))))


def _sweep(units: list[str], control: str, idle: Callable) -> None:
    i = 0
    while i < len(units):
        if units[i] == control and idle(units, i):
            del units[i]
        else:
            i += 1


_CONTROLS = frozenset(("Zwj", "Zwnj", "Mvs"))


def control_rounds(units: tuple[str, ...]) -> tuple[str, ...]:
    """Without controls that change nothing: repeated ones, then joiners, then breaks, until none goes."""
    if _CONTROLS.isdisjoint(units):
        return units
    out = list(units)
    while True:
        before = len(out)
        out = [u for i, u in enumerate(out) if not (i and u == out[i - 1] and u in ("Zwj", "Zwnj", "Mvs"))]
        left = -1
        while left != len(out):
            left = len(out)
            _sweep(out, "Zwj", _joiner_is_idle)
        _sweep(out, "Zwnj", _break_is_idle)
        if len(out) == before:
            return tuple(out)


def canonical_units(units: tuple[str, ...]) -> tuple[str, ...]:
    return contract(control_rounds(expand(units)))


# Words to units ---------------------------------------------------------------------------------------------------
def shape_raw(word: str) -> tuple[str, ...]:
    w = Word(word)
    return _raw(w, written_by_token(w, conditions(w)))


@lru_cache(200_000)
def shape(word: str) -> tuple[str, ...]:
    return canonical_units(shape_raw(word))


def detail(word: str) -> list[dict]:
    w = Word(word)
    cond = conditions(w)
    forms = written_by_token(w, cond)
    return [{"cp": ord(w.char[i]), "alias": w.alias[i], "position": w.position[i], "fvs": w.fvs[i][0] if w.fvs[i] else None, "condition": cond[i], "written": list(forms[i])} for i in range(w.n)]


def trace(word: str) -> dict:
    w = Word(word)
    before: list = [None] * w.n
    steps = []
    for name, cond in run_rules(w):
        changes = [{"token": i, "before": a, "after": b} for i, (a, b) in enumerate(zip(before, cond, strict=True)) if a != b]
        if changes:
            steps.append({"rule": name, "changes": changes})
        before = list(cond)
    forms = written_by_token(w, before)
    return {"positions": w.position, "transitions": steps, "final_conditions": before, "written_by_token": [list(f) for f in forms], "shape": list(canonical_units(_raw(w, forms)))}


# Units to words ---------------------------------------------------------------------------------------------------
def _spell_chain(chain: tuple[str, ...], before: int, after: int) -> str | None:
    """Letters for a chain: a single unit where the table has one, else the longest run."""
    c, total = catalogue(), len(chain) + before + after
    letters: list[tuple[str, str]] = []
    single: list[str | None] = []
    i = 0
    while i < len(chain):
        for length in (1, *range(min(c.longest, len(chain) - i), 1, -1)):
            if found := c.encode.get((place_of(i + before, length, total), chain[i : i + length])):
                break
        else:
            return None
        letters.append(found)
        single.append(chain[i] if length == 1 else None)
        i += length
    total = len(letters) + before + after
    for k in range(len(letters) - 1):
        if single[k] in ("G", "Gx") and single[k + 1] and place_of(k + before, 1, total) in ("init", "medi") and letters[k + 1][0] in c.masculine:
            letters[k + 1] = c.encode_feminine.get((place_of(k + 1 + before, 1, total), single[k + 1])) or letters[k + 1]
    return "".join(text for _, text in letters)


def _spell_segment(units: tuple[str, ...], aa: str) -> str:
    """A sequence without breaks, from its last chain to its first: each must give its units before what follows."""
    parts = list(_chains(units))
    text, target = "", ()
    for k in range(len(parts) - 1, -1, -1):
        chain, before, after = parts[k]
        if before < 0:
            text, target = _CHAR_OF[chain[0]] + text, chain + target
            continue
        lead: tuple[str, ...] = ()
        for other, flag, _ in reversed(parts[:k]):
            if flag >= 0:
                break
            lead = other + lead
        head = "".join(map(_CHAR_OF.__getitem__, lead))
        want = control_rounds(lead + chain + target)
        spelt = None
        if lead[-1:] == ("Mvs",):
            alone = aa if chain == ("Aa",) else _spell_chain(chain, 0, 0)
            if alone and alone != aa and shape(alone) != control_rounds(chain):
                alone = None
            if alone and shape(head + alone + text) == want:
                spelt = alone
        if spelt is None:
            joined = _spell_chain(chain, int(lead[-1:] in (("Nirugu",), ("Zwj",))), int(target[:1] in (("Nirugu",), ("Zwj",))))
            spelt = joined if joined is not None and shape(head + joined + text) == want else ""
        text, target = spelt + text, chain + target
    return text


def _spell(units: tuple[str, ...]) -> str:
    """The canonical text of canonical units, or nothing."""
    plain = catalogue().char["a"]
    for aa in (plain, plain + "\u180c"):
        if "Zwnj" not in units:
            text = _spell_segment(units, aa)
        else:
            segments, pieces = [[]], []
            for u in units:
                segments.append([]) if u == "Zwnj" else segments[-1].append(u)
            for s in segments:
                pieces.append(_spell_segment(tuple(s), aa))
                if shape(pieces[-1]) != tuple(s):
                    break
            text = ZWNJ.join(pieces) if len(pieces) == len(segments) and shape(pieces[-1]) == tuple(segments[-1]) else ""
        if text and shape(text) == units:
            return text
    return ""


@lru_cache(200_000)
def normalize(word: str, lenient: bool = False) -> str:
    units = shape(word)
    if not word or not units:
        return ""
    if text := _spell(units):
        return text
    if lenient:
        return word
    raise NormalizationFallback(word, units)


def normalize_text(text: str, lenient: bool = False) -> str:
    return "".join(normalize(m[0], lenient) if m[1] else m[0] for m in _RUNS.finditer(text))


def encode_units(units: tuple[str, ...]) -> str:
    """The canonical text of written units."""
    known = catalogue().known
    for i, u in enumerate(units):
        if u not in known:
            raise WordError("UnsupportedWrittenUnit", f"written_units[{i}] is unknown: '{_shown(u)}'", i)
    if not units:
        return ""
    if text := _spell(canonical_units(units)):
        return text
    raise WordError("NoCanonicalEncoding", "written-unit sequence has no canonical MNG encoding")


def encode_positioned(records: list[tuple[str, str]]) -> str:
    """The canonical text of (unit, position) records; joiners and breaks follow from the positions."""
    c = catalogue()
    if len(records) > MAX_RECORDS:
        raise WordError("TooManyRecords", f"positioned_units accepts at most {MAX_RECORDS} records")
    for unit, _ in records:
        if unit in ("Zwj", "Zwnj"):
            raise WordError(f"Explicit{unit}", f"unsupported positioned control '{unit}'")
    for i, (unit, position) in enumerate(records):
        if unit in ("Mvs", "Nirugu"):
            if position != "control":
                raise WordError("ControlRequiresControlPosition", f"positioned_units[{i}] control '{unit}' requires position 'control'", i)
        elif (unit, position) not in c.positioned:
            raise WordError("UnsupportedPositionedUnit", f"unsupported positioned written unit '{unit}:{position}'", i)
    for i, (unit, _) in enumerate(records):
        follower = records[i + 1] if i + 1 < len(records) else (None, None)
        if unit == "Mvs" and follower == ("Aa", "isol"):
            raise WordError("RedundantChachlagMvs", f"positioned_units[{i}] has redundant 'Mvs' before 'Aa:isol'", i)
        if unit == "Mvs" and follower[1] not in ("init", "isol"):
            raise WordError("ChainPositionMismatch", "positioned written-unit sequence has no canonical MNG encoding in the supplied context")
    # controls as strings, chains as lists of records
    parts: list = []
    before: tuple[str, str] | None = None
    for unit, position in records:
        own = (unit, position)
        joining = lambda r: r[1] != "control" or r[0] in JOINERS
        if own == ("Aa", "isol"):
            parts += ["Mvs", [own]]
        else:
            apart = before and joining(before) and joining(own) and (before[1] in ("fina", "isol") or position in ("init", "isol"))
            if apart:
                parts.append("Zwnj")
            if position == "control":
                parts.append(unit)
            elif parts and isinstance(parts[-1], list):
                parts[-1].append(own)
            else:
                parts.append([own])
        before = own
    units: list[str] = []
    for k, part in enumerate(parts):
        if isinstance(part, str):
            units.append(part)
            continue
        left = k > 0 and parts[k - 1] in ("Nirugu", "Zwj")
        right = k + 1 < len(parts) and parts[k + 1] in ("Nirugu", "Zwj")
        last, place = part[-1]
        if not left and part[0][1] in ("medi", "fina"):
            units.append("Zwj")
        units += [u for u, _ in part]
        open_end = place == "medi" or len(part) == 1 and not left and place == "init" and _needs_joiner(last)
        if open_end and not right:
            units.append("Zwj")
    return encode_units(tuple(units))


def encode_records(records: object) -> str:
    """encode_positioned of records as they come from outside: a list of objects with unit and position."""
    if not isinstance(records, (list, tuple)):
        raise WordError("RecordType", "positioned_units must be an ordered sequence of records")
    if len(records) > MAX_RECORDS:
        raise WordError("TooManyRecords", f"positioned_units accepts at most {MAX_RECORDS} records")
    known = frozenset((*POSITIONS, "control"))
    for i, record in enumerate(records):
        if not isinstance(record, dict):
            raise WordError("RecordType", f"positioned_units[{i}] must be a record", i)
        if set(record) != {"unit", "position"}:
            raise WordError("RecordFields", f"positioned_units[{i}] must contain exactly 'unit' and 'position'", i)
        for field in ("unit", "position"):
            if not isinstance(record[field], str):
                raise WordError("RecordType", f"positioned_units[{i}].{field} must be a string", i)
        if record["position"] not in known:
            raise WordError("UnknownPosition", f"positioned_units[{i}] has unknown position {record['position']!r}", i)
    return encode_positioned([(r["unit"], r["position"]) for r in records])


def encode_json(text: str) -> str:
    """encode_records of records in JSON."""
    try:
        records = json.loads(text)
    except ValueError as e:
        raise WordError("RecordType", f"positioned_units must be JSON: {e}") from None
    return encode_records(records)


def _needs_joiner(unit: str) -> bool:
    """Whether a lone initial unit would be read as isolated."""
    if (unit, "isol") in catalogue().positioned:
        return True
    try:
        encode_units((unit,))
    except WordError:
        return True
    return False


def parse_units(text: str) -> tuple[str, ...]:
    """Units from 'B+Aa' or 'BAa'; the latter must have one reading."""
    text = text[:-2] if text.endswith("\r\n") else text[:-1] if text.endswith(("\n", "\r")) else text
    if not text:
        return ()
    if any(c.isspace() for c in text):
        raise WordError("InvalidUnitSpec", "written units cannot be empty or contain whitespace")
    known = catalogue().known
    if "+" in text:
        units = tuple(text.split("+"))
        if "" in units:
            raise WordError("InvalidUnitSpec", "written units cannot be empty or contain whitespace; separate explicit units with '+' (for example A+Aa+B+Zwj)")
        for i, u in enumerate(units):
            if u not in known:
                raise WordError("UnknownWrittenUnit", f"written_units[{i}] is unknown: '{_shown(u)}'", i)
        return units
    longest = max(map(len, known))
    # readings of what starts at each place: at most two are told apart
    ways: list[list[tuple[str, ...]]] = [[] for _ in text] + [[()]]
    for i in range(len(text) - 1, -1, -1):
        heads = (text[i:j] for j in range(i + 1, min(len(text), i + longest) + 1))
        ways[i] = [(h, *rest) for h in heads if h in known for rest in ways[i + len(h)]][:2]
    if not ways[0]:
        raise WordError("UnknownWrittenUnit", f"written_units[0] is unknown: '{_shown(text)}'", 0)
    if len(ways[0]) > 1:
        raise WordError("InvalidUnitSpec", "compact written-unit sequence is ambiguous; separate units with '+'")
    return ways[0][0]


def spell_aliases(text: str) -> str:
    """A word from aliases: 't a l mvs a'."""
    c = catalogue().char
    extra = {"mvs": MVS, "nnbsp": NNBSP, "nirugu": NIRUGU, "zwj": ZWJ, "zwnj": ZWNJ, **{f"fvs{n}": f for f, n in FVS_NUMBER.items()}}
    return "".join(c.get(a) or extra[a] for a in text.split())
