"""What the near-duplicate join sends of a group of near copies that meets many texts without links."""

import random

import numpy as np

from verdance.llm import ngram_join


def _texts(copies, others, seed=5):
    """Copies of one text with a word changed each (all linked at 0.8), and others with three words changed each (none linked)."""
    rng = random.Random(seed)
    base = [f"w{i}" for i in range(120)]
    out = []
    for i in range(copies + others):
        words = list(base)
        for k in [rng.randrange(10, 110)] if i < copies else [x + rng.randrange(5) for x in rng.sample(range(10, 110, 10), 3)]:
            words[k] = f"x{i}y{k}"
        out.append((i, " ".join(words)))
    rng.shuffle(out)
    return out


def _sets(text):
    words = text.split()
    return {tuple(words[k : k + 5]) for k in range(len(words) - 4)}


def _components(texts):
    sets = {i: _sets(t) for i, t in texts}
    forest = ngram_join._Forest()
    for i, x in sets.items():
        for j, y in sets.items():
            if i < j and 100 * len(x & y) >= 80 * len(x | y):
                forest.join(i, j)
    return {i: forest.root(i) for i in sets}


def _run(spark, monkeypatch, texts):
    """The components, and how many rows ask for sets."""
    asked = []
    keep = ngram_join.Scratch.keep

    def counted(self, df):
        kept = keep(self, df)
        if kept[0].columns == ["id", "d1", "p", "q", "side"]:
            asked.append(kept[0].count())
        return kept

    monkeypatch.setattr(ngram_join.Scratch, "keep", counted)
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in ngram_join.near_duplicate_classes(docs, size=5, percent=80).collect()}
    monkeypatch.undo()
    return got, sum(asked)


def test_a_group_is_not_sent_for_each_text_it_meets(spark, monkeypatch):
    texts = _texts(300, 150)
    got, asked = _run(spark, monkeypatch, texts)
    assert got == _components(texts)
    assert len(set(got.values())) == 151
    assert asked < 8 * len(texts)


def test_small_tiles_and_pieces_lose_no_link(spark, monkeypatch):
    for name, value in (("BLOCK", 8), ("TILE", 6), ("TILE_COUNT", 4), ("PIECE", 4)):
        monkeypatch.setattr(ngram_join, name, value)
    rng = random.Random(9)
    texts = [(i, t) for i, t in _texts(60, 40)]
    # Chains: each text changes one more word of the one before, so only neighbours link and components have many blocks.
    for chain in range(3):
        words = [f"c{chain}w{i}" for i in range(60)]
        for step in range(40):
            words[rng.randrange(5, 55)] = f"c{chain}s{step}"
            texts.append((1000 + 100 * chain + step, " ".join(words)))
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in ngram_join.near_duplicate_classes(docs, size=5, percent=80).collect()}
    assert got == _components(texts)


def test_pieces_hold_all_sets_in_bounds():
    rng = np.random.default_rng(1)
    sets = [(i, np.arange(n, dtype=np.uint64)) for i, n in enumerate(rng.integers(1, 40_000, 400))] + [(400, np.arange(ngram_join.PIECE_TOKENS + 5, dtype=np.uint64))]
    pieces = ngram_join._pieces(sets)
    assert [i for piece in pieces for i, _ in piece] == list(range(401))
    assert all(len(piece) <= ngram_join.PIECE and (len(piece) == 1 or sum(len(x) for _, x in piece) <= ngram_join.PIECE_TOKENS) for piece in pieces)
    assert ngram_join._pieces([]) == []
