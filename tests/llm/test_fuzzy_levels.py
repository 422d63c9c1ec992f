import random

import numpy as np

from loomgraph.llm.fuzzy import Fingerprints, likeness


def prose(draw, n):
    return " ".join("".join(draw.choice("etaoinshr") for _ in range(draw.randint(2, 9))) for _ in range(n))


def near(a, b):
    x, y = Fingerprints([a.encode()]), Fingerprints([b.encode()])
    return likeness(x.take(np.array([0])), y.take(np.array([0])))[0]


def test_texts_of_one_repeated_passage_have_full_signatures():
    draw = random.Random(8)
    for words, times in ((1, 4000), (3, 500), (12, 300), (40, 2000), (2, 9)):
        text = (prose(draw, words) + " ") * times
        edited = text[: len(text) - len(text) // 3] + prose(draw, len(text))[: len(text) // 3]
        print = Fingerprints([text.encode()])
        assert 12 <= (print.one[0] < 64).sum() <= 64
        assert near(text, edited) > 0.4 and near(text, prose(draw, len(text) // 6)) < 0.3


def test_all_of_a_text_is_in_its_signature():
    draw = random.Random(4)
    base = prose(draw, 5) + " "
    for times in (60, 700):
        head = base * times
        tails = [prose(draw, len(head) // 12) for _ in range(2)]
        assert near(head + tails[0], head + tails[1]) < 0.9
    for text in (prose(draw, 4000), base * 900):
        assert (Fingerprints([text.encode()]).one[0] < 64).sum() <= 64
