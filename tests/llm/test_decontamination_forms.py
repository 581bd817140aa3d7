from __future__ import annotations

import pytest

from phonolake.llm import decontam

FRUIT = "Tom has 5 apples and Ann has 7 pears. Tom buys 3 more apples at the market. Ann gives him 2 pears. How many pieces of fruit does Tom have now?"
FILLER = "the river ran slowly past the old mill and nobody watched it go. "


def held(item: str, text: str) -> list[tuple]:
    reader, index = decontam.Reader(), decontam.Index([(1, item)])
    literal, kind, joins, bounds = reader.read_many([FILLER.encode(), (FILLER + text + " " + FILLER).encode()])
    at = index.candidates(literal, kind, joins, bounds).tolist()
    own = slice(bounds[1], bounds[2])
    return index.search(literal[own], kind[own], joins[own], decontam.MIN_SHARE) if 1 in at else []


FORMS = {
    "names and digits": FRUIT.replace("Tom", "Bob").replace("Ann", "Eve").replace("5", "15").replace("7", "9").replace("3", "6").replace("2", "4"),
    "number words": FRUIT.replace("5", "five").replace("7", "twenty-one"),
    "numbers of two words": FRUIT.replace("5", "thirty five").replace("7", "two hundred"),
    "a name of two words": FRUIT.replace("Tom", "Mary Ann"),
    "two values that coincide": FRUIT.replace("5", "6").replace("7", "6"),
    "all at once": FRUIT.replace("Ann has", "Lee Roy has").replace("Ann gives", "Lee Roy gives").replace("Tom", "Mary Ann").replace("5", "six").replace("7", "6"),
}


@pytest.mark.parametrize("form", FORMS)
def test_other_names_and_numbers(form):
    assert [(f[0], f[4]) for f in held(FRUIT, FORMS[form])] == [(1, False)]


def test_one_value_that_becomes_two():
    assert held(FRUIT, FRUIT) and held(FRUIT, FRUIT)[0][4]
    item = "A farmer sells 12 crates of apples at the market and later buys the same 12 crates of apples from the shop"
    assert held(item, item.replace("12", "9")) and not held(item, item.replace("12", "9", 1).replace("12", "8"))
    assert held(item, item.replace("12", "9", 1).replace("12", "nine"))


@pytest.mark.parametrize("change", [str.upper, str.lower, str.title, lambda t: t.replace(".", "").replace(",", "").replace("?", "")])
def test_copies_in_another_case_or_without_punctuation(change):
    german = "Die Straße nach Köln ist lang. Anna fährt 40 Kilometer, dann isst sie 3 Äpfel. Wie weit ist sie gefahren?"
    for item in (FRUIT, german):
        assert [(f[0], f[4]) for f in held(item, change(item))] == [(1, True)]
        assert [f[0] for f in held(change(item), item)] == [1]


@pytest.mark.parametrize("item", ["Compute 12 × 34 + 56 − 78 = ?", "Solve 3 + 4 * 5 - 6 = 17", "Anna, Bernd, Clara, Dieter, Emma, Fritz, Gerda", "12 34", "Paris"])
def test_items_short_of_literals(item):
    assert [(f[0], f[3], f[4]) for f in held(item, item)] == [(1, 1.0, True)]
    assert not held(item, "nothing of it")
