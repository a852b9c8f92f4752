"""Toxicity reads every letter run of a word."""

import random

import pyarrow as pa

from tarnwick.llm import toxicity


def test_every_letter_run_is_read():
    assert toxicity.tokens_of("L'Idiot") == ["l", "idiot"] and toxicity.tokens_of("12%") == [""]
    r = random.Random(2)
    plain = lambda: [f"{r.choice('bcdfg')}{r.choice('aeiou')}{r.choice('lmnrs')}" for _ in range(30)]
    texts, labels = [], []
    for k in range(200):
        words = plain()
        words[5:8] = ["l'zorblax", "you/krumpet", "(the)zorblax"] if k % 4 < 2 else ["l'bal", "you/bal", "(the)bal"]  # both folds have both kinds
        texts.append(" ".join(words))
        labels.append(int(k % 4 < 2))
    model = toxicity.fit(texts, labels)
    rest = plain()
    joined, apart, clean = (" ".join([*rest[:9], *x, *rest[9:]]) for x in (["l'zorblax", "you/krumpet", "好zorblax。krumpet"], "l zorblax you krumpet 好zorblax krumpet".split(), ["l'bal", "you/bal", "bal"]))
    (a, spans), (b, _), (c, _) = model.scores(pa.array([joined, apart, clean]))
    assert a == b > 0.8 and c < 0.3
    assert [(first, last) for _, first, last in spans] == [(9, 11)]  # in word positions
