import random
import unicodedata

import pytest
from hypothesis import given
from hypothesis import strategies as st

from tracewell.functions import quotes, signs
from tracewell.functions.locate import exact, to_claims, tolerant
from tracewell.functions.quotes import cuts_a_number, cuts_a_word, says_the_same
from tracewell.functions.sentences import sentences
from tracewell.functions import textview
from tracewell.functions.textview import INVISIBLE, normal, view


@given(st.text(alphabet="ab \t\n­​éé’“–Ⅳß가", max_size=30))
def test_view_keeps_a_place_for_every_offset(text):
    shown, places = view(text)
    assert len(places) == len(text) + 1 and places[-1] == len(shown)
    known = [p for p in places if p is not None]
    assert known == sorted(known)
    composed = unicodedata.normalize("NFC", "".join(c for c in text if c not in INVISIBLE))
    assert shown.split() == composed.translate({0x2019: "'", 0x201C: '"', 0x2013: "-"}).split() or any(c in INVISIBLE for c in text)


def test_normal():
    assert normal("  The “Quick” \n fox—jumps­ ") == 'the "quick" fox-jumps'
    assert normal("10²") != normal("102") and normal("é") == normal("é")


@pytest.mark.parametrize("source, cited", [
    ("he said, yes", "he said yes"), ("he said \"yes.\"", "he said \"yes\""), ("66 300 people", "66,300 people"), ("it ended.", "it ended"),
    ("it ended", "it ended."), ("it ended...", "it ended."), ("march 11, 2011", "march 11 2011"),
])
def test_setting_may_differ(source, cited):
    assert says_the_same(source, cited)


@pytest.mark.parametrize("source, cited", [
    ("it is safe", "it is unsafe"), ("66,300 people", "66300 people"), ("since 1998, 183 people", "since 1998,183 people"), ("a - 5", "a -5"),
    ("10%", "10"), ("is it so?", "is it so!"), (".5% of it", "5% of it"), ("", ""), ("a (b)", "a b"), ("it ended", "it ended?"),
])
def test_content_may_not(source, cited):
    assert not says_the_same(source, cited) or source == cited == ""


@pytest.mark.parametrize("c", "!#$%&()*+/:;<=>@[]^_`{|}~§€²½")
def test_nothing_else_is_forgiven(c):
    assert not says_the_same(f"one {c} two", "one two") and not says_the_same("one two", f"one {c} two")


@pytest.mark.parametrize("text, quote, cut", [
    ("The report found 66 300 people", "300 people", True), ("1,500 people", "500 people", True), ("a rise of 3.5%", "3.5", True), ("-5 degrees", "5 degrees", True),
    ("$40 million", "40 million", True), ("in 2011 300 people", "300 people", False), ("ten 5 six", "5", False), ("at 10:30 today", "30 today", True), ("page 5.", "page 5", False),
])
def test_numbers(text, quote, cut):
    at = text.index(quote)
    assert cuts_a_number(text, at, at + len(quote)) is cut


@pytest.mark.parametrize("text, quote, cut", [
    ("the drug is unsafe", "safe", True), ("the drug is unsafe", "unsafe", False), ("don't go", "t go", True), ("well-known", "known", True),
    ("contentShare it", "Share it", False), ("line\\nNext", "Next", False), ("unsafe", "un", True), ("café bar", "bar", False), ("iPhone", "Phone", True),
])
def test_words(text, quote, cut):
    at = text.rindex(quote)
    assert cuts_a_word(text, at, at + len(quote)) is cut


def test_boundaries_inside_a_letter():
    assert cuts_a_word("café", 0, 4) and not cuts_a_number("café", 0, 4)


def test_long_sources_are_read_near_the_span_only():
    text = "word " * 200_000
    assert not cuts_a_word(text, 500_000, 500_004) and not cuts_a_number("x" * 700_000, 10, 20)


def test_locate():
    assert exact("Alpha beta alpha", "alpha") == (11, 16) and exact("Alpha beta", "BETA", []) == (6, 10)
    assert exact("aa aa", "aa", [(0, 2)]) == (3, 5) and exact("a", " ") is None
    assert tolerant("it rose, by 5 points", "rose by 5 points") == (3, 20)
    assert tolerant("it rose by -5 points", "by 5 points") is None
    assert to_claims("One two. Three four.", (0, 20), [(0, 8), (9, 20)]) == ([(0, 8), (9, 20)], [])
    assert to_claims("One two. Three four.", (4, 14), [(0, 8)]) == ([], [(0, 8)])


def test_sentences():
    text = "Dr. Smith went to the U.S. in May. He came back later.\n# a heading of words here\nShort.\nIt cost 3.5 dollars more"
    assert [text[a:b] for a, b in sentences(text)] == ["Dr. Smith went to the U.S. in May.", "He came back later.", "It cost 3.5 dollars more"]


@pytest.mark.parametrize("text, quote, cut", [
    ("a loss of -$5.2 million", "$5.2 million", True), ("a loss of -$5.2 million", "-$5.2 million", False), ("x=5 here", "5 here", False), ("Version 1→2 is out", "2 is", False), ("US$1.183 billion", "1.183", True),
    ("65+ years", "65", True), ("72° today", "72", True), ("margin - 5.2 % of it", "5.2 %", True), ("margin - 5.2 % of it", "- 5.2 %", False), ("a rise (5%) was", "5%", True), ("it is 3947 / 7 now", "7 now", True),
    ("| 5 | 6 |", "5", False), ("Bond 007•398K views", "398K", False), ("take 5 ½ cups", "½ cups", True), ("10⁻31 kg", "31 kg", True), ("list\n- 5 apples", "5 apples", False), ("so - 5 apples", "5 apples", True),
    ("some € 120 now", "120 now", True), ("it is 25 °C now", "25", True), ("arXiv:1804.1", "1804.1", False), ('"Paris",2161000', "2161000", False), ("about ,500 people", "500 people", True), ("a .5% share", "5% share", True),
    ("5-year plan", "5", False), ("$100-$300 each", "$300 each", True), ("66 300 people", "300 people", True), ("66​300", "300", True), ("2011 300 people", "300 people", False), ("it cost 5 € in all", "5", True), ("paid 5 €3 back", "5", False),
])
def test_numbers_are_read_whole(text, quote, cut):
    at = text.rindex(quote)
    assert cuts_a_number(text, at, at + len(quote)) is cut


@given(st.lists(st.sampled_from(["5", "66", "300", "½", "²", "$", "€", "-", "+", ".", ",", ":", "%", "°", " ", "  ", "x", "word", "(", ")", "/", "×", "=", "|", "\n", "​"]), max_size=12), st.data())
def test_spans_between_numbers_cut_none(parts, data):
    """A span that is all of its text cuts nothing; one that cuts a number is no longer cut when it takes all of the text."""
    text = "".join(parts)
    assert not text or not cuts_a_number(text, 0, len(text))
    if len(text) > 1:
        a = data.draw(st.integers(0, len(text) - 1))
        b = data.draw(st.integers(a + 1, len(text)))
        if not any(unicodedata.category(c)[0] == "N" for c in text[a:b]):
            assert not cuts_a_number(text, a, b) or unicodedata.category(text[a - 1 : a] or "x")[0] == "N"


def test_words_of_a_text():
    from tracewell.functions.locate import core, outside, words

    assert [w for *_, w in words("A 3.5% rise, (5%) or -7 in 2020-2021; don't (you)")] == ["a", "3.5%", "rise", "(5%)", "or", "-7", "in", "2020-2021", "don", "t", "you"]
    assert core('  "Yes," he said.', (0, 17)) == (3, 16) and outside("ab cd ef", (0, 8), [(0, 2)]) == 4


@pytest.mark.parametrize("text, quote, found", [
    ("a loss of $5 million", "-$5 million", None), ("a loss of -$5 million", "loss of -$5 million", "loss of -$5 million"), ("COVID-19 cases rose", "covid 19 cases", "COVID-19 cases"), ("it rose (5%) then", "rose 5% then", None),
    ("One, two; three", "one two three", "One, two; three"), ("66 300 people", "300 people", None), ("...", "...", None),
])
def test_located_with_the_numbers_that_are_stated(text, quote, found):
    span = tolerant(text, quote)
    assert (span and text[slice(*span)]) == found


def test_view_of_ascii_as_walked():
    draw = random.Random(5)
    for _ in range(2000):
        text = "".join(draw.choice("ab1-'\".,\\ \t\n\r\x0b\x1c\x1f\x00\x7f") for _ in range(draw.randrange(9)))
        for drop in (textview.unseen, textview.unprinted):
            assert textview.view(text, drop) == textview._walked(text, drop)


def test_signs_are_read_only_where_a_numeral_is(monkeypatch):
    """Without numerals no number is cut, whatever stands there; with them signs are as by the plain formula."""
    draw = random.Random(7)
    for k in range(3000):
        text = "".join(draw.choice("ab-+.,$( \n\t" + ("12²½Ⅳ٣​́é" if k % 2 else "")) for _ in range(draw.randrange(1, 12)))
        start = draw.randrange(len(text))
        around = quotes.Around(text, start, draw.randrange(start + 1, len(text) + 1))
        raw = {}
        for at, place in enumerate(around.places):
            if place is not None:
                raw.setdefault(place, around.lo + at)
        want = "".join(s.upper() if s in "pm" and signs.opens_its_line(text, raw[at]) else s for at, s in enumerate(signs.signs_of(around.shown)))
        assert around.signs() == (want if set(want) & set("devn") else "")
    monkeypatch.delattr(quotes, "signs_of")
    text = "No numeral stands here - none at all."
    assert not cuts_a_number(text, 3, 20) and cuts_a_word(text, 4, 20)
