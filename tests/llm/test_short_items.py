"""Decontamination by items of every length, and by items in scripts without spaces, against brute force."""

from __future__ import annotations

import random

import pytest
from test_corpus import plain_distance

from weftgraph.llm import decontaminate
from weftgraph.llm.decontaminate import words_of


def searched(items, texts):
    found = {f[:2] for f in decontaminate.Index(items, **decontaminate.OPTIONS).search(texts)}
    want = set()
    for d, t in enumerate(texts):
        words = words_of(t)
        want |= {(d, k) for k, x in items if plain_distance(words_of(x), words, 0) <= int(0.2 * len(words_of(x)))}
    return found, want


def edited(rng, part, n, words):
    for _ in range(n):
        p = rng.randrange(len(part))
        part[p : p + 1] = rng.choice([[], [part[p], rng.choice(words)], [rng.choice(words)]])
    return part


@pytest.mark.parametrize("length", [1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 13, 15, 20, 40])
@pytest.mark.parametrize("edits", [0, 1])
def test_recall_at_each_length(length, edits):
    rng = random.Random(length)
    words = [f"w{i}" for i in range(400)]
    items = [(k, " ".join(rng.choices(words, k=length))) for k in range(60)]
    texts = [" ".join([*rng.choices(words, k=30), *edited(rng, t.split(), edits * int(0.2 * length), words), *rng.choices(words, k=30)]) for _, t in items]
    found, want = searched(items, texts)
    assert found <= want and len(want) >= 55
    assert found == want if length < decontaminate.OPTIONS["long_words"] else len(found) >= 0.97 * len(want)


@pytest.mark.parametrize("length", [2, 4, 8, 15, 40])
def test_recall_without_spaces(length):
    rng = random.Random(length)
    kana = [chr(c) for c in range(0x3041, 0x3097)] + [chr(c) for c in range(0x4E00, 0x4E80)]
    items = [(k, "".join(rng.choices(kana, k=length))) for k in range(40)]
    texts = ["".join([*rng.choices(kana, k=60), *edited(rng, list(t), int(0.2 * length), kana), "。", *rng.choices(kana, k=60)]) for _, t in items]
    found, want = searched(items, texts)
    assert found <= want and len(found) >= 0.97 * len(want) > 0


def test_short_items_inside_documents():
    chinese = "机器学习是人工智能的一个分支，它研究计算机怎样从数据中学习。"
    items = [(0, chinese), (1, "internationalization standardization"), (2, "capital of France is"), (3, "ภาษาไทยเขียนติดกันโดยไม่เว้นวรรค")]
    texts = ["前言。" + chinese + "后记" * 9, "前言" + chinese.replace("数据", "资料") + "后记", "about Internationalization, standardization and more", "The capital, of France: is it?", "capital of France", "คำนำ" + items[3][1] + "จบ", "前言后记"]
    found = {f[:2] for f in decontaminate.Index(items, **decontaminate.OPTIONS).search(texts)}
    assert found == {(0, 0), (1, 0), (2, 1), (3, 2), (5, 3)}
