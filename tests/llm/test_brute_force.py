"""The automaton, the trainer, the quotas and the chunker against plain versions of themselves."""

import math
import random
from collections import defaultdict

import numpy as np
import pandas as pd
from test_mixing import naive

from loomgraph.llm import fuzzy, mixing, quality, toxicity


def test_hits_are_those_of_a_naive_search():
    draw = random.Random(4)
    letters = lambda n: "".join(draw.choice("abo ") for _ in range(n))
    for _ in range(200):
        terms = {" " + letters(draw.randint(1, 4)).strip(): 1.0 + i for i in range(4)}
        phrases = tuple(" " + letters(draw.randint(3, 6)) for _ in range(2))
        terms = {t: w for t, w in terms.items() if t not in phrases}
        text = toxicity.fold(letters(60))
        want = []
        exempt = [(i, i + len(p)) for p in phrases for i in range(len(text)) if text.startswith(p, i)]
        for i in range(len(text)):
            own = max((t for t in terms if text.startswith(t, i)), key=len, default=None)
            if own and not any(a <= i and i + len(own) <= b for a, b in exempt):
                want.append((i, i + len(own), terms[own]))
        assert toxicity.hits(text, toxicity._automaton(toxicity.Lexicon(terms, phrases))) == want


def test_folding_sees_through_marks_and_forms():
    plain = toxicity.fold("skrumbag")
    for text in ("s\u200bkrum\u00adbag", "ｓｋｒｕｍｂａｇ", "𝐬𝐤𝐫𝐮𝐦𝐛𝐚𝐠", "s\u0336k\u0336rumbag", "SKRUMB@G", "ѕkrumbаg"):
        assert toxicity.fold(text) == plain
    assert toxicity.fold("été") == " été" and toxicity.fold("a-b") == " a b"


def test_training_is_a_plain_follow_the_regularised_leader_loop():
    p, draw = quality.Params(bits=6, epochs=3), random.Random(2)
    rows = []
    for i in range(60):
        at = sorted(draw.sample(range(64), 5))
        rows.append((draw.randrange(1000), [*at], [draw.random() for _ in at], i % 2))
    w, bias = quality.train_shard(pd.DataFrame(rows, columns=["draw", "index", "value", "label"]), p)
    z, n = defaultdict(float), defaultdict(float)

    def weight(j):
        if abs(z[j]) <= p.l1:
            return 0.0
        return -(z[j] - math.copysign(p.l1, z[j])) / ((p.beta + math.sqrt(n[j])) / p.alpha + p.l2)

    for _ in range(p.epochs):
        for _, at, values, label in sorted(rows, key=lambda r: r[0]):
            row = {**dict(zip(at, values)), 64: 1.0}
            now = {j: weight(j) for j in row}
            score = 1 / (1 + math.exp(-sum(now[j] * v for j, v in row.items())))
            for j, v in row.items():
                g = (score - label) * v
                z[j] += g - (math.sqrt(n[j] + g * g) - math.sqrt(n[j])) / p.alpha * now[j]
                n[j] += g * g
    assert np.allclose(w, [weight(j) for j in range(64)]) and math.isclose(bias, weight(64), rel_tol=1e-9)


def test_shards_get_the_seats_of_highest_quotients(spark):
    draw, p = random.Random(6), mixing.Params()
    rows, want = [], {}
    for key in range(12):
        sizes = [draw.choice([0, draw.randint(1, 40), draw.randint(100, 3000)]) for _ in range(draw.randint(1, 9))]
        sizes[0] = max(sizes[0], 5)
        target = draw.uniform(0.1, 1.9) * sum(sizes)
        blocks = round(target / p.block_words)
        quota = [min(2 * s, n * p.block_words) for s, n in zip(sizes, naive(sizes, blocks))]
        rest = math.floor(target + 0.5) - sum(quota)
        for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):  # the largest shards settle the difference
            step = min(2 * sizes[i] - quota[i], rest) if rest > 0 else -min(quota[i], -rest)
            quota[i], rest = quota[i] + step, rest - step
        want |= {(key, i): q for i, q in enumerate(quota)}
        rows += [(key, i, s, target, False, blocks) for i, s in enumerate(sizes)]
    df = spark.createDataFrame(rows, "key int, shard long, shard_size long, target double, full boolean, blocks long")
    assert {(r["key"], r["shard"]): r["quota"] for r in mixing._shard_quotas(df, p).collect()} == want


def slow_signature(text: bytes, level: int, longest: int, half: bool) -> str:
    """The letters of a text at a level, byte by byte."""
    mixed = []
    for i in range(len(text)):
        h = sum(int(fuzzy._TABLE[text[i - j]]) << j for j in range(8) if i - j >= 0) % (1 << 32)
        h = h * 0x9E3779B1 % (1 << 32)
        h ^= h >> 15
        mixed.append(h * 0x85EBCA77 % (1 << 32))
    bound = 1 << (32 - level)
    out, begin = [], 0
    letter = lambda a, b: chr(fuzzy.LETTERS[(sum(mixed[a:b]) * 0x9E3779B97F4A7C15 % (1 << 64)) >> 58])
    for i, h in enumerate(mixed):
        own = h < bound // 2 if half else h <= min(bound - 1, 0xFFFFFFFF)
        if len(out) < fuzzy.MOST - 1 and (own or i + 1 - begin == longest):
            out.append(letter(begin, i + 1))
            begin = i + 1
    if begin < len(text):
        out.append(letter(begin, len(text)))
    return "".join(out)


def test_signatures_are_those_of_a_slow_chunker():
    draw = random.Random(8)
    texts = [bytes(draw.choices(b"abcdefgh \n", k=n)) for n in (1, 7, 40, 300, 2000, 9000)] + [b"ab" * 700, "été ".encode() * 200]
    for text, print_ in zip(texts, fuzzy.Fingerprints(texts).text()):
        size, one, two = print_.split(":")
        level = int(size).bit_length() - 1
        usual = max(0, math.ceil(math.log2(len(text) / fuzzy.AIM)))
        assert one == slow_signature(text, level, 2 << min(level, usual), False)
        assert two == slow_signature(text, level, 4 << min(level, usual), True)
