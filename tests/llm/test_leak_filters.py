"""What rules out windows and pieces of a text before they are compared with an item loses nothing."""

import random

import numpy as np

from verdance.llm import decontaminate
from verdance.llm.decontaminate import ItemIndex, fit_distance, leaks, may_hold

_WORDS = random.Random(1)
WORDS = ["".join(_WORDS.choice("etaoinshrdlu") for _ in range(i % 7 + 2)) for i in range(2000)]


def _text(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def test_runs_in_common_are_asked_for_before_the_edit_distance():
    rng = random.Random(3)
    items = ItemIndex([(i, _text(rng, n)) for i, n in enumerate([5, 8, 12, 20, 40] * 8)], 0.8).items
    held = unlike = 0
    for x in items:
        for share in (0, 0.1, 0.2, 0.25):
            t = list(x.text)
            for at in sorted(rng.sample(range(len(t)), int(share * len(t))), reverse=True):
                t[at : at + rng.randrange(2)] = rng.choice(["q", "", "zz"])
            piece = f"{_text(rng, 3)} {''.join(t)} {_text(rng, 3)}"
            if fit_distance(x.text, piece, x.edits) <= x.edits:
                assert may_hold(x, piece)
                held += 1
        unlike += not may_hold(x, _text(rng, 30))
    assert held > 80 and unlike > 30


def test_halves_rule_out_windows_without_loss(monkeypatch):
    rng = random.Random(4)
    items = [(i, _text(rng, n)) for i, n in enumerate([7, 10, 18, 40] * 12)]
    texts = [f"{_text(rng, 60)} {t[: len(t) // 2]}q{t[len(t) // 2 + 1 :]} {_text(rng, 60)}".encode() for _, t in items]
    data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0] + [len(t) for t in texts])
    index = ItemIndex(items, 0.8)
    made = []
    real = decontaminate.samples
    monkeypatch.setattr(decontaminate, "samples", lambda parts, coordinates: made.append(len(parts[0])) or real(parts, coordinates))
    found = leaks(data, offsets, index, False)
    few = sum(made)
    made.clear()
    for x in index.windows:
        for sieves in x.sieves:
            for sieve in sieves:
                sieve[:] = 1
    assert found == leaks(data, offsets, index, False) and {(x.row, x.item_id) for x in found} >= {(i, i) for i in range(len(items))}
    assert few < 0.5 * sum(made)
