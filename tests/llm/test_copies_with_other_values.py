from __future__ import annotations

import random

import pytest

from phonolake.llm import decontam, langid, packing
from test_decontamination_forms import FILLER, FRUIT, held

SCHEMA = "doc_id long, text string"
NAMES = ["Tom", "Ann", "Bob", "Eve", "Lea", "Max", "Ida", "Kim"]


def changed(text, names, numbers):
    return " ".join(names.get(w, numbers.get(w, w)) for w in text.split())


def test_a_stray_phrase_does_not_make_a_copy():
    item = "A farmer sells 12 crates of apples at the market and later buys the same 12 crates of apples from the shop"
    mixed = item.replace("12", "9", 1).replace("12", "8")
    stray = "sells 12 crates of apples at"
    assert not held(item, mixed)
    for text in (f"{mixed} {FILLER * 5} {stray}", f"{stray} {FILLER * 5} {mixed}", f"{stray} {mixed}", f"{mixed} {stray}"):
        assert not held(item, text)


def test_words_put_in_between_part_nothing():
    item = FRUIT
    text = changed(item, {"Tom": "Bob", "Ann": "Eve"}, {"5": "15", "7": "9", "3": "6", "2": "4"})
    middle = text.index("Bob buys")
    text = text[:middle] + "as was said before in the story " + text[middle:]
    assert [(f[0], f[4]) for f in held(item, text)] == [(1, False)]
    wrong = text.replace("Bob buys 6", "Lea buys 6")
    assert not held(item, wrong)


def test_literal_pieces_far_apart():
    words = [f"word{i}" for i in range(80)]
    text = (FILLER * 9).join([" ".join(words[:40]) + " ", " " + " ".join(words[36:])])
    assert [(f[0], f[3], f[4]) for f in held(" ".join(words), text)] == [(1, 1.0, True)]


def items_with_values(n, seed):
    """Questions of plain words in which every seventh word is a number and every ninth a name, with their values."""
    r = random.Random(seed)
    out = []
    for k in range(n):
        names, numbers = r.sample(NAMES, 3), [str(r.randint(2, 99)) for _ in range(3)]
        words = ["".join(r.choice("abcdefgh") for _ in range(r.randint(3, 8))) for _ in range(45)]
        for i in range(3, 45, 7):
            words[i] = r.choice(numbers)
        for i in range(5, 45, 9):
            words[i] = r.choice(names)
        out.append((k, " ".join(words), names, list(dict.fromkeys(numbers))))
    return out


def test_planted_copies_with_other_values_are_found(spark):
    items = items_with_values(60, 5)
    r = random.Random(6)
    docs, want = [], set()
    for k, text, names, numbers in items:
        new_names = dict(zip(names, r.sample(["Ruth", "Paul", "Nora", "Hugo", "Olga"], 3), strict=True))
        new_numbers = dict(zip(numbers, r.sample([str(x) for x in range(100, 200)], len(numbers)), strict=True))
        docs.append((k, FILLER * 3 + changed(text, new_names, new_numbers) + " " + FILLER))
        want.add((k, k))
        words = text.split()  # every value becomes another one at each place
        odd = [w if w not in names and not w.isdigit() else r.choice(["Ruth", "Paul", "Nora", "Hugo"]) if w in names else str(r.randint(100, 10**6)) for w in words]
        docs.append((1000 + k, FILLER + " ".join(odd)))
        docs.append((2000 + k, FILLER * 4))
    bench = spark.createDataFrame([(k, t) for k, t, *_ in items], "item_id long, text string")
    found = {(x.doc_id, x.item_id) for x in decontam.contaminated(spark.createDataFrame(docs, SCHEMA), bench).collect()}
    assert len(found & want) >= 0.9 * len(want) and not {d for d, _ in found - want if d >= 2000}
    assert len({d for d, _ in found if 1000 <= d < 2000}) <= 6


def test_null_item_ids(spark):
    rows = [(1, FRUIT), (2, FILLER)]
    bench = spark.createDataFrame([(None, FRUIT), (-1, FILLER * 2 + "one more"), (3, None), (4, "")], "item_id long, text string")
    got = decontam.contaminated(spark.createDataFrame(rows, SCHEMA), bench).collect()
    assert [(x.doc_id, x.item_id) for x in got] == [(1, None)]
    assert decontam.contaminated(spark.createDataFrame(rows, SCHEMA), bench.limit(0)).count() == 0
    assert decontam.contaminated(spark.createDataFrame([], SCHEMA), bench).count() == 0


def test_texts_without_a_letter():
    model = langid.KernelModel.fit(langid.np.stack([langid.presence("the cat"), langid.presence("der hund")]), ["en", "de"])
    names, scores = model.predict(["² ½ ³", "12 34", "!?", "", None, "the cat", "١٢"])
    assert names == ["und"] * 5 + ["en", "und"] and scores[:5] == [0.0] * 5


def best_pair(sizes, cap):
    pairs = [x + y for i, x in enumerate(sizes) for y in sizes[i + 1 :] if x + y <= cap]
    return max(pairs, default=0)


@pytest.mark.parametrize("seed", range(40))
def test_the_two_that_replace_the_smallest_are_the_best(seed):
    r = random.Random(seed)
    lengths = [r.randint(1, 30) for _ in range(r.randint(2, 25))]
    first, _ = packing.plan_bins({x: lengths.count(x) for x in lengths}, 40)[0]
    left, greedy, gap = sorted(lengths, reverse=True), [], 40
    for x in list(left):
        if x <= gap:
            greedy.append(x)
            left.remove(x)
            gap -= x
    want = sum(greedy)
    if gap and len(greedy) > 1:
        want += max(0, best_pair([*left, greedy[-1]], gap + greedy[-1]) - greedy[-1])
    assert sum(first) == want


def test_other_tokenizers_encode_whole_texts():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    assert packing.cuts_words(packing.default_tokenizer()) and not packing.cuts_words(path)
    texts = ["Two  spaces and\n\nLines", "", "Ünïcode 12345 don't"]
    want = [x.ids for x in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]
    assert [x.tolist() for x in packing.WordTokenizer(path).encode_many([t.encode() for t in texts])] == want
