"""Toxicity by weak supervision.

1. Voters, each of which says toxic, clean or nothing about a text: word lists in four languages; lists of words and of word stems induced from
   labelled rows, sure and likely ones apart; patterns (an insult that addresses someone, masked letters, shouting, density). All ids are dealt to
   ``FOLDS`` folds; the lists that vote on a fold's texts are induced from the other folds, so no text is judged by a list that its own label has made.
2. A generative label model: the hidden label chooses a vote of each voter, given the vote of the one voter on which it depends most (a tree of
   conditional correlations, learned with the rest by expectation maximisation). It is fitted on the votes of all texts, labelled or not, as
   counts of vote patterns; of the labels it gets the share of toxic ones and, to start from, how the voters vote on each.
3. A linear classifier over words and stems learns the posterior labels (FTRL with an L1 penalty) and scores every text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, ship_by_value, text_slices
from .linear import ftrl, labelled_ids, remainder, sample, sigmoid
from .textkernel import ALNUM, mix, words, words_and_beginnings

#: Labelled ids and bytes of their texts learned from at most; letters in a stem; bytes worked on at once.
SAMPLE_ROWS, SAMPLE_BYTES, STEM, SLICE = 8000, 32 << 20, 5, 1 << 20
#: Least hashes in a band, and bands, by which copies are told while inducing lists.
BAND, BANDS = 3, 4
#: Texts of the sample in which a feature must occur for the classifier to weigh it.
LEAST_TEXTS = 3
#: Penalty that leaves out what few texts need, and passes over the sample at most.
L1, EPOCHS = 4.0, 10
#: Share of toxic texts among those that hold a likely and a sure word, and folds of ids.
LIKELY, SURE, FOLDS = 0.6, 0.95, 5
#: Many words share a stem, so stems count where a text holds them twice at least and in this share of its words.
DENSE = 0.006
#: Insults in English (two lists), German, French and Spanish, and words that address someone (fixed values).
INSULTS = (
    "idiot moron stupid dumb fool imbecile loser clown jerk pathetic".split(),
    "trash scum worthless disgusting garbage filth vermin ugly hate shut".split(),
    "dummkopf trottel depp vollidiot arschloch abschaum versager blödmann dreckskerl widerling".split(),
    "connard connasse salaud salope imbécile crétin abruti débile ordure minable".split(),
    "idiota imbécil estúpido estúpida tonto basura asqueroso gilipollas cabrón payaso".split(),
)
ADDRESS = "you your youre du dein ihr euch tu toi vous votre tú usted vosotros".split()
#: Words before an insult in which an address counts; signs that mask letters.
REACH, MASKS = 3, b"*#@$%"
#: Voters in order; the last two may also vote clean.
VOTERS = ("en1", "en2", "de", "fr", "es", "addressed", "masked", "shouting", "sure_words", "likely_words", "sure_stems", "likely_stems", "word_density", "stem_density")
CLEAN, TOXIC, NONE = 0, 1, 2


def bags(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of words (even) and of their stems (odd), and the bounds of the texts."""
    _, _, whole, start, bounds = words_and_beginnings(data, offsets, ALNUM, STEM, latin=True)
    one = np.uint64(1)
    return whole & ~one, start | one, bounds


def hash_words(texts: list[str]) -> np.ndarray:
    data = np.frombuffer(" ".join(texts).encode(), np.uint8)
    return np.unique(words(data, np.array([0, len(data)]), ALNUM, latin=True)[2] & ~np.uint64(1))


def _sums(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags)])
    return total[bounds[1:]] - total[bounds[:-1]]


def fixed_votes(data: np.ndarray, offsets: np.ndarray, whole: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Votes of the voters that need no labels, a row for each text."""
    lists = [np.isin(whole, hash_words(x)) for x in INSULTS]
    insult = np.logical_or.reduce(lists)
    address = np.concatenate([[0], np.cumsum(np.isin(whole, hash_words(ADDRESS)))])
    at = np.arange(len(whole))
    first = np.maximum(at - REACH, np.repeat(bounds[:-1], np.diff(bounds)))
    addressed = insult & (address[at] > address[first])
    signs = np.isin(data, np.frombuffer(MASKS, np.uint8))
    letter = ALNUM[data]
    masked = np.zeros(len(data), bool)
    if len(data) > 3:
        masked[1:-2] = letter[:-3] & signs[1:-2] & (signs[2:-1] & letter[3:] | letter[2:-1])
    upper = _sums((data >= 0x41) & (data <= 0x5A), offsets)
    lower = _sums((data >= 0x61) & (data <= 0x7A), offsets)
    columns = [_sums(x, bounds) > 0 for x in (*lists, addressed)]
    columns += [_sums(masked, offsets) > 0, upper > 0.3 * np.maximum(upper + lower, 1)]
    return np.where(np.column_stack(columns), TOXIC, NONE)


@dataclass(frozen=True)
class Lists:
    """Induced lists: hashes of words (even) and stems (odd), in order; bit ``k`` tells whether a hash is in the sure or likely list for fold ``k``."""

    hashes: np.ndarray
    sure: np.ndarray
    likely: np.ndarray

    def votes(self, whole: np.ndarray, stems: np.ndarray, bounds: np.ndarray, fold: np.ndarray) -> np.ndarray:
        n = np.maximum(np.diff(bounds), 1)
        of_word = np.repeat(fold, np.diff(bounds)).astype(np.uint8)
        columns, densities = [], []
        for h in (whole, stems):
            place = np.searchsorted(self.hashes, h)
            hit = np.flatnonzero(place < len(self.hashes))
            hit = hit[self.hashes[place[hit]] == h[hit]]
            both = []
            for bits in (self.sure, self.likely):
                flags = np.zeros(len(h), np.uint8)
                flags[hit] = bits[place[hit]] >> of_word[hit] & 1
                both.append(_sums(flags, bounds))
            columns += [x > 0 for x in both] if h is whole else [(x >= 2) & (x / n >= DENSE) for x in both]
            densities.append(both[0] + both[1])
        word, stem = densities
        by_word = np.where(word / n >= DENSE / 2, TOXIC, np.where(word == 0, CLEAN, NONE))
        by_stem = np.where((stem / n >= 2 * DENSE) & (stem >= 2), TOXIC, np.where(stem / n < DENSE / 3, CLEAN, NONE))
        return np.column_stack([np.where(np.column_stack(columns), TOXIC, NONE), by_word, by_stem])


def vote_codes(data: np.ndarray, offsets: np.ndarray, fold: np.ndarray, lists: Lists) -> np.ndarray:
    """The votes on each text as one number; ``fold`` is that of its id."""
    whole, stems, bounds = bags(data, offsets)
    v = np.column_stack([fixed_votes(data, offsets, whole, bounds), lists.votes(whole, stems, bounds, fold)])
    return v @ 3 ** np.arange(v.shape[1])


def decode(codes: np.ndarray) -> np.ndarray:
    return codes[:, None] // 3 ** np.arange(len(VOTERS)) % 3


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row, data, offsets in text_slices(batch.column(2), SLICE):
            whole, start, bounds = bags(data, offsets)
            out = [[], []]
            for i in range(len(bounds) - 1):
                part = slice(bounds[i], bounds[i + 1])
                for k, x in enumerate(np.unique(np.concatenate([whole[part], start[part]]), return_counts=True)):
                    out[k].append(x.astype((np.uint64, np.int32)[k]).tobytes())
            columns = [batch.column(0).slice(row, len(bounds) - 1), batch.column(1).slice(row, len(bounds) - 1), *(pa.array(x, pa.binary()) for x in out), pa.array(np.diff(bounds))]
            yield pa.RecordBatch.from_arrays(columns, ["label", "fold", "words", "counts", "n"])


def least_hashes(x: np.ndarray) -> set[tuple]:
    """Bands of a text's least hashes; texts that have one in common are as good as copies."""
    return {(b, *(int(mix(x ^ np.uint64(97 * b + k + 1)).min()) for k in range(BAND))) for b in range(BANDS)} if len(x) else {()}


def induce(texts: list[np.ndarray], counts: list[np.ndarray], n: np.ndarray, labels: np.ndarray, fold: np.ndarray) -> Lists:
    """Words that occur, and stems that are dense, in toxic texts far too often for chance (Chernoff bound, over all features tried).

    Copies prove nothing: a text that agrees with an earlier one in all least hashes of some band is left out here.
    """
    seen: set[tuple] = set()
    own = []
    for i, x in enumerate(texts):
        keys = least_hashes(x)
        if not keys & seen:
            own.append(i)
        seen |= keys
    own = np.array(own, int)
    one = np.uint64(1)
    held = [texts[i][(texts[i] & one == 0) | (counts[i] >= 2) & (counts[i] >= DENSE * n[i])] for i in own]
    vocabulary, inverse = np.unique(np.concatenate([*held, np.zeros(0, np.uint64)]), return_inverse=True)
    of_text = np.repeat(np.arange(len(own)), [len(x) for x in held])
    sure, likely = (np.zeros(len(vocabulary), np.uint8) for _ in range(2))
    for k in range(FOLDS):
        others = fold[own] != k
        if len(set(labels[own][others])) < 2:
            continue
        base = labels[own][others].mean()
        counted = others[of_text]
        total = np.bincount(inverse[counted], minlength=len(vocabulary)).astype(float)
        toxic = np.bincount(inverse[counted & (labels[own][of_text] == 1)], minlength=len(vocabulary)).astype(float)
        share = toxic / np.maximum(total, 1)
        with np.errstate(divide="ignore", invalid="ignore"):
            divergence = np.where(share > 0, share * np.log(share / base), 0) + np.where(share < 1, (1 - share) * np.log((1 - share) / (1 - base)), 0)
        tried = max(1, int((total >= 3).sum()))
        listed = (toxic >= 3) & (share >= LIKELY) & (total * divergence > np.log(tried))
        sure |= (listed & (share >= SURE)).astype(np.uint8) << np.uint8(k)
        likely |= (listed & (share < SURE)).astype(np.uint8) << np.uint8(k)
    some = (sure | likely) > 0
    return Lists(vocabulary[some], sure[some], likely[some])


@dataclass
class LabelModel:
    """P(vote | label, vote of the parent) for each voter; the first voters in ``order`` come before those that depend on them."""

    prior: float
    order: list[int]
    parent: np.ndarray
    tables: np.ndarray

    def posterior(self, v: np.ndarray) -> np.ndarray:
        """P(label 1) for each row of votes. A voter that says nothing counts for nothing, and none counts against what it says."""
        logit = np.full(len(v), np.log(self.prior / (1 - self.prior)))
        for j in self.order:
            before = v[:, self.parent[j]] if self.parent[j] >= 0 else 0
            ratio = np.log(self.tables[1, j, before, v[:, j]]) - np.log(self.tables[0, j, before, v[:, j]])
            logit += np.select([v[:, j] == TOXIC, v[:, j] == CLEAN], [np.maximum(ratio, 0), np.minimum(ratio, 0)], 0.0)
        return sigmoid(logit)


def label_model(v: np.ndarray, counts: np.ndarray, prior: float, known: tuple[np.ndarray, np.ndarray] | None = None, rounds: int = 50) -> LabelModel:
    """Fitted by expectation maximisation on vote patterns ``v`` that occur ``counts`` times; ``prior`` stays as given.

    It starts from the votes on some texts of ``known`` labels, ``(votes, labels)``, else from the texts with most toxic votes.
    """
    m = v.shape[1]

    def fitted(votes: np.ndarray, n: np.ndarray, toxic: np.ndarray) -> LabelModel:
        one_hot = np.zeros((len(votes), 3 * m))
        one_hot[np.arange(len(votes))[:, None], 3 * np.arange(m) + votes] = 1.0
        joint = np.stack([one_hot.T @ (one_hot * (n * p)[:, None]) for p in (1 - toxic, toxic)]).reshape(2, m, 3, m, 3)
        return _tree(joint.transpose(0, 1, 3, 2, 4), prior)  # label, voter, voter, vote, vote

    if known is not None:
        model = fitted(known[0], np.ones(len(known[0])), known[1].astype(float))
    else:
        score = (v == TOXIC).sum(axis=1) - 0.5 * (v == CLEAN).sum(axis=1)
        order = np.argsort(-score, kind="stable")
        likely = np.cumsum(counts[order]) <= max(prior * counts.sum(), 1)
        least = score[order][likely].min() if likely.any() else score.max()
        model = fitted(v, counts, np.where(score >= max(least, 0.5), 0.95, 0.05))
    posterior = model.posterior(v)
    for _ in range(rounds):
        model = fitted(v, counts, posterior)
        new = model.posterior(v)
        if np.abs(new - posterior).max() < 1e-4:
            break
        posterior = new
    return model


def _tree(joint: np.ndarray, prior: float) -> LabelModel:
    """The tree of voters with the largest mutual information given the label, and its tables."""
    m = joint.shape[1]
    total = joint[:, 0, 0].sum(axis=(1, 2)).sum() + 1e-9
    p = (joint + 1e-3) / total
    alone = np.stack([p[:, j, j].diagonal(axis1=1, axis2=2) for j in range(m)], axis=1)  # label, voter, vote
    of_label = p[:, 0, 0].sum(axis=(1, 2))
    ratio = p * of_label[:, None, None, None, None] / (alone[:, :, None, :, None] * alone[:, None, :, None, :] + 1e-12)
    information = (p * np.log(ratio + 1e-12)).sum(axis=(0, 3, 4))
    np.fill_diagonal(information, -np.inf)
    parent, order, out = np.full(m, -1), [0], set(range(1, m))
    while out:
        i, j = max(((i, j) for i in order for j in sorted(out)), key=lambda x: information[x])
        parent[j] = i
        order.append(j)
        out.remove(j)
    tables = np.zeros((2, m, 3, 3))
    for j in order:
        counts = joint[:, parent[j], j] if parent[j] >= 0 else np.repeat(joint[:, j, j].diagonal(axis1=1, axis2=2)[:, None, :], 3, axis=1)
        marginal = joint[:, j, j].diagonal(axis1=1, axis2=2)[:, None, :] + 0.5
        # A vote of the parent that was seen seldom says little: the voter's own shares fill in.
        filled = counts + 2.0 * marginal / marginal.sum(axis=2, keepdims=True)
        tables[:, j] = filled / filled.sum(axis=2, keepdims=True)
    return LabelModel(prior, order, parent, tables)


@dataclass(frozen=True)
class Model:
    """Weights of the features that matter, in order of their hashes, and a table that rules out most others at once."""

    hashes: np.ndarray
    weights: np.ndarray
    bias: float

    def maybe(self) -> np.ndarray:
        table = np.zeros(1 << 16, bool)
        table[(self.hashes & np.uint64(0xFFFF)).astype(np.int64)] = True
        return table

    def score(self, data: np.ndarray, offsets: np.ndarray, maybe: np.ndarray) -> np.ndarray:
        whole, start, bounds = bags(data, offsets)
        total = np.zeros(len(offsets) - 1)
        if len(self.hashes):
            for h, value in ((whole, np.ones(len(total))), (start, scale(np.diff(bounds)))):
                at = np.flatnonzero(maybe[(h & np.uint64(0xFFFF)).astype(np.int64)])
                place = np.minimum(np.searchsorted(self.hashes, h[at]), len(self.hashes) - 1)
                hit = self.hashes[place] == h[at]
                text = np.searchsorted(bounds, at[hit], "right") - 1
                both, counts = np.unique(np.stack([text, place[hit]]), axis=1, return_counts=True)
                np.add.at(total, both[0], self.weights[both[1]] * damped(counts) * value[both[0]])
        return sigmoid(self.bias + total)


def damped(counts: np.ndarray) -> np.ndarray:
    """A word said again says less than the first time, though never nothing."""
    return np.log2(1.0 + counts)


def scale(n: np.ndarray) -> np.ndarray:
    """The value of one stem: common texts hold some by chance, so their share counts. A word counts 1."""
    return 5.0 / np.sqrt(np.maximum(n, 25))


def fold_of(row_id: str):
    """A number below ``FOLDS`` by a hash of the id; a null id has one too."""
    return F.pmod(F.xxhash64(F.col(row_id).cast("long"), F.lit(3)), F.lit(FOLDS)).cast("int")


def vote_patterns(docs: DataFrame, lists: Lists, text: str = "text", row_id: str = "doc_id") -> tuple[np.ndarray, np.ndarray]:
    """The votes on all texts: patterns and how often each occurs. There are at most ``2 ** 12 * 3 ** 2`` patterns, whatever the input."""
    sent = docs.sparkSession.sparkContext.broadcast(lists)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, int] = {}
        for batch in batches:
            fold = batch.column(0).to_numpy(zero_copy_only=False)
            for row, data, offsets in text_slices(batch.column(1), SLICE):
                codes = vote_codes(data, offsets, fold[row : row + len(offsets) - 1], sent.value)
                for code, n in zip(*(x.tolist() for x in np.unique(codes, return_counts=True)), strict=True):
                    total[code] = total.get(code, 0) + n
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array(list(total.values()), pa.int64())], ["code", "n"])

    each = map_arrow(docs.select(fold_of(row_id).alias("fold"), F.col(text).alias("text")), work, "code long, n long")
    found = each.groupBy("code").agg(F.sum("n").alias("n")).orderBy("code").toArrow()
    return decode(found["code"].to_numpy()), found["n"].to_numpy().astype(float)


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, text: str = "text", row_id: str = "doc_id") -> Model:
    chosen = labelled_ids(labels, "toxic", row_id, remainder(row_id, 5) != 0, sample_rows)
    # Bounded by sample_rows and SAMPLE_BYTES; the texts stay where they are.
    learned = sample(docs, chosen, row_id, text, SAMPLE_BYTES).select("label", fold_of("label_id").alias("fold"), "text")
    sent = map_arrow(learned, _rows, "label int, fold int, words binary, counts binary, n long").toArrow().to_pylist()
    sent.sort(key=lambda r: (r["label"], r["words"], r["counts"]))
    y = np.array([r["label"] for r in sent])
    if len(set(y)) < 2:
        return Model(np.zeros(0, np.uint64), np.zeros(0), float(np.clip(y.sum() * 8 - 4, -4, 4)) if len(y) else 0.0)
    bag, counts = [np.frombuffer(r["words"], np.uint64) for r in sent], [np.frombuffer(r["counts"], np.int32) for r in sent]
    fold, n = (np.array([r[c] for r in sent]) for c in ("fold", "n"))
    del sent
    lists = induce(bag, counts, n, y, fold)
    prior = float(np.clip(y.mean(), 0.01, 0.99))
    votes = _sample_votes(learned, lists)
    known = np.array([votes[text_key(x, c)] for x, c in zip(bag, counts, strict=True)])
    model = label_model(*vote_patterns(docs, lists, text, row_id), prior, (known, y))
    targets = model.posterior(known)

    vocabulary, inverse = np.unique(np.concatenate(bag), return_inverse=True)
    ids = np.split(inverse.astype(np.int32), np.cumsum([len(x) for x in bag])[:-1])
    common = np.bincount(inverse, minlength=len(vocabulary)) >= LEAST_TEXTS
    is_stem = vocabulary % np.uint64(2) == 1
    rows = []
    for x, c, f in zip(ids, counts, scale(n), strict=True):
        c, x = c[common[x]], x[common[x]]
        rows.append((np.append(x, len(vocabulary)), np.append(damped(c) * np.where(is_stem[x], f, 1.0), 1.0)))
    fit = lambda at: ftrl([rows[i] for i in at], targets[at], len(vocabulary) + 1, alpha=0.5, l1=L1, l2=0.05, epochs=EPOCHS)
    # The penalty holds weights down but not the bias: move it to where the posterior labels part best in texts that weren't learned from.
    logits = np.zeros(len(rows))
    for part in range(3):
        weights = fit(np.flatnonzero(fold // 2 != part))
        for i in np.flatnonzero(fold // 2 == part):
            logits[i] = weights[rows[i][0]] @ rows[i][1] - weights[-1]
    weights = fit(np.arange(len(rows)))
    weights[-1] = -_parting(logits, targets >= 0.5)
    matter = np.flatnonzero(weights[:-1])
    return Model(vocabulary[matter], weights[:-1][matter], float(weights[-1]))


def text_key(found: np.ndarray, counts: np.ndarray) -> bytes:
    return hashlib.md5(found.tobytes() + counts.tobytes(), usedforsecurity=False).digest()


def _sample_votes(learned: DataFrame, lists: Lists) -> dict[bytes, np.ndarray]:
    """The votes on each text learned from, by its bag of words."""
    sent = learned.sparkSession.sparkContext.broadcast(lists)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fold = batch.column(1).to_numpy(zero_copy_only=False)
            for row, data, offsets in text_slices(batch.column(2), SLICE):
                codes = vote_codes(data, offsets, fold[row : row + len(offsets) - 1], sent.value)
                whole, start, bounds = bags(data, offsets)
                keys = []
                for a, b in zip(bounds[:-1], bounds[1:], strict=True):
                    found, counts = np.unique(np.concatenate([whole[a:b], start[a:b]]), return_counts=True)
                    keys.append(text_key(found, counts.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(codes, pa.int64())], ["key", "code"])

    out = map_arrow(learned, work, "key binary, code long").toArrow()
    return dict(zip(out["key"].to_pylist(), decode(out["code"].to_numpy()), strict=True))


def _parting(logits: np.ndarray, toxic: np.ndarray) -> float:
    """The middle of the range of thresholds with the fewest errors."""
    order = np.argsort(logits, kind="stable")
    logits, toxic = logits[order], toxic[order]
    errors = np.concatenate([[0], np.cumsum(toxic)]) + np.concatenate([np.cumsum(~toxic[::-1])[::-1], [0]])
    edges = np.concatenate([[logits[0] - 2], logits, [logits[-1] + 2]])
    best = np.flatnonzero(errors == errors.min())
    best = best[np.argmax(edges[best + 1] - edges[best])]
    return float((edges[best] + edges[best + 1]) / 2)


def score_toxicity(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, text: str = "text", row_id: str = "doc_id") -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row of ``docs``.

    Labels are learned from at most ``sample_rows`` labelled ids, one row each, whose crc32(id) mod 5 is not 0; of several labels for an id the
    largest counts. An empty or null text gets the
    score of the bias; repeated rows get equal scores; an empty table gives no rows; a null id is kept. Without
    labels of both kinds every score is that of the one kind there is, or 0.5.
    """
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, sample_rows, text, row_id))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maybe = model.value.maybe()
        for batch in batches:
            parts = [model.value.score(data, offsets, maybe) for _, data, offsets in text_slices(batch.column(2), SLICE)]
            scores = np.concatenate([np.zeros(0), *parts])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(scores), pa.array((scores >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col(row_id).cast("long").alias("doc_id"), (remainder(row_id, 5) == 0).alias("held_out"), F.col(text).alias("text"))
    return map_arrow(rows, score, "doc_id long, held_out boolean, score double, predicted int")


ship_by_value(__name__)
