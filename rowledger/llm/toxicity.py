"""Toxicity: support vector machine with a subsequence string kernel and Nystroem landmarks.

Two strings are alike by the subsequences of three and four characters that they share, each weighted down by
``DECAY`` for every character skipped inside it, so "idiot", "id-iot" and "idiiot" stay close. The kernel's features
are hashed; landmark strings span a low-dimensional subspace (Nystroem), in which a linear machine with squared hinge
loss is trained. Because kernel, projection and machine are all linear in the features, they fold into one weight per
feature, which is all that scoring needs.

The strings are the words of a sentence (and runs of single letters, joined). The labels mark whole texts only, so
training alternates: take the worst strings of each toxic text and strings of clean texts, train, and choose again
(multiple-instance training). It begins with runs of characters that are commoner in toxic texts. Some chosen
strings are added in disguise, with characters put in. A second machine in the same subspace, trained on whole texts,
weighs the strings that the first one blames: one strong string is enough, moderate ones add up. A logistic curve
turns the sum into a score.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowledger.llm import tokens as T

SIZE = 1 << 16
DECAY = 0.6
WIDTH = 24          # bytes of a string's piece, with its two end marks
STRIDE = 1          # longer strings are cut at every byte: what fits in a piece stands whole in one
LANDMARKS = 192
ROUNDS = 3
FIT_TEXTS = 3000    # bound of the labelled sample, texts per class
FIT_BYTES = 1 << 19  # of texts taken apart at a time
FIT_STRINGS = 6000  # bound of the strings per class and round
RUNS = (5, 6, 8)    # bytes of the runs that training begins with; the mark of a word's beginning counts as one
SURE = 4.0          # standard errors that a run's log odds must be above zero
CLEAR = 0.9         # of the texts with a seed, so many are toxic if it alone is enough

_PATTERNS = [((0, *rest), DECAY ** (rest[-1] + 1 - size)) for size, reach in ((3, 4), (4, 5))
             for rest in itertools.combinations(range(1, reach + 1), size - 1)]
_FACTORS = np.array([2654435761, 2246822519, 3266489917, 668265263], np.uint32)


@dataclass
class Strings:
    codes: np.ndarray   # pieces as rows of bytes: 1 begins, 2 ends, 0 is padding
    owner: np.ndarray   # string of each piece
    text: np.ndarray    # text of each occurrence
    string: np.ndarray  # string of each occurrence
    hashes: np.ndarray  # of each string, ascending

    def blamed(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The worst piece of each string above zero; of each of their occurrences, its place there and its text."""
        order = np.lexsort((-values, self.owner))
        first = np.flatnonzero(np.diff(self.owner[order], prepend=-1))
        pieces = order[first][values[order[first]] > 0]
        place = np.full(self.owner.max(initial=-1) + 1, -1)
        place[self.owner[pieces]] = np.arange(len(pieces))
        there = place[self.string] >= 0
        return pieces, place[self.string[there]], self.text[there]


def strings(data: np.ndarray, at: np.ndarray) -> Strings:
    """Distinct strings of a chunk: words without outer punctuation, and runs of four or more single letters."""
    w = T.words(data, at)
    text = w.text_of()
    plain = np.flatnonzero(~T.PUNCTUATION[data])
    first, last = np.searchsorted(plain, w.start), np.searchsorted(plain, w.end)
    full = last > first
    start, end, text = plain[first[full]], plain[last[full] - 1] + 1, text[full]
    single = end - start == 1
    joins = single[1:] & single[:-1] & (text[1:] == text[:-1])
    runs_from = np.flatnonzero(single & ~np.concatenate([[False], joins])[: len(single)])
    runs_to = np.flatnonzero(single & ~np.concatenate([joins, [False]])[: len(single)])
    lowered = T.LOWER[data]
    long = runs_to - runs_from >= 3
    # the letters of the runs are appended as further words
    size = (runs_to - runs_from + 1)[long]
    letters = np.repeat(runs_from[long] - np.cumsum(size) + size, size) + np.arange(size.sum())
    lowered, joined = np.concatenate([lowered, lowered[start[letters]]]), len(lowered) + np.cumsum(size)
    text, start, end = np.concatenate([text, text[runs_from[long]]]), np.concatenate([start, joined - size]), np.concatenate([end, joined])
    hashes = T.span_hashes(lowered, start, end)
    distinct, sample, string = np.unique(hashes, return_index=True, return_inverse=True)
    start, end = start[sample], end[sample]
    # pieces of WIDTH - 2 bytes, every STRIDE bytes
    length = end - start
    pieces = np.maximum(1, -(-(length - (WIDTH - 2)) // STRIDE) + 1)
    owner = np.repeat(np.arange(len(distinct)), pieces)
    number = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    offset = number * STRIDE
    begin, size = start[owner] + offset, np.minimum(length[owner] - offset, WIDTH - 2)
    codes = np.zeros((len(owner), WIDTH), np.uint8)
    for i in range(min(WIDTH - 2, int(size.max(initial=0)))):
        have = np.flatnonzero(size > i)
        codes[have, i + 1] = lowered[begin[have] + i]
    codes[:, 0] = number == 0
    ends = np.flatnonzero(number == pieces[owner] - 1)
    codes[ends, size[ends] + 1] = 2
    return Strings(codes, owner, text, string, distinct)


def all_strings(texts: list[str]) -> Strings:
    """The same of many texts, taken some at a time."""
    parts = [(first, strings(data, at)) for first, _, data, at in T.chunks(pa.array(texts, pa.string()), FIT_BYTES)]
    if not parts:
        return strings(np.zeros(0, np.uint8), np.zeros(1, np.int64))
    hashes = np.unique(np.concatenate([s.hashes for _, s in parts]))
    known = np.zeros(len(hashes), bool)
    codes, owner, text, string = [], [], [], []
    while parts:
        first, s = parts.pop(0)
        place = np.searchsorted(hashes, s.hashes)
        new = ~known[place]
        known[place] = True
        pieces = new[s.owner]
        codes.append(s.codes[pieces])
        owner.append(place[s.owner[pieces]].astype(np.int32))
        text.append((s.text + first).astype(np.int32))
        string.append(place[s.string].astype(np.int32))
    owner = np.concatenate(owner)
    order = np.argsort(owner, kind="stable").astype(np.int32)
    place = np.empty_like(order)
    place[order] = np.arange(len(order), dtype=np.int32)
    laid, first = np.empty((len(order), WIDTH), np.uint8), 0
    for part in codes:
        laid[place[first : first + len(part)]] = part
        first += len(part)
    return Strings(laid, owner[order], np.concatenate(text), np.concatenate(string), hashes)


def features(codes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, float]]:
    """(bucket, present, weight) for every way to pick a subsequence."""
    wide = codes.astype(np.uint32)
    for offsets, weight in _PATTERNS:
        n = codes.shape[1] - offsets[-1]
        bucket = np.zeros((len(codes), n), np.uint32)
        present = np.ones((len(codes), n), bool)
        for k, o in enumerate(offsets):
            column = wide[:, o : o + n]
            bucket = (bucket ^ column) * _FACTORS[k]
            present &= column > 0
        yield (bucket ^ (bucket >> np.uint32(15))) % np.uint32(SIZE), present, weight


def evaluate(codes: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Weighted, normalised features of each piece."""
    out = np.zeros(len(codes))
    for i in range(0, len(codes), 8192):
        part = codes[i : i + 8192]
        total, norm = np.zeros(len(part)), np.full(len(part), 1e-9)
        for bucket, present, weight in features(part):
            total += weight * (weights[bucket] * present).sum(axis=1)
            norm += weight * weight * present.sum(axis=1)
        out[i : i + 8192] = total / np.sqrt(norm)
    return out


def matrix(codes: np.ndarray) -> np.ndarray:
    """Dense, normalised features of a few strings, a column each."""
    columns = np.zeros((SIZE, len(codes)), np.float32)
    norm = np.full(len(codes), 1e-9)
    line = np.arange(len(codes))[:, None]
    for bucket, present, weight in features(codes):
        np.add.at(columns, (bucket[present], np.broadcast_to(line, bucket.shape)[present]), np.float32(weight))
        norm += weight * weight * present.sum(axis=1)
    columns /= np.sqrt(norm).astype(np.float32)
    return columns


def kernel(codes: np.ndarray, turned: np.ndarray) -> np.ndarray:
    """Kernel values between strings and landmarks; ``turned`` has the landmarks' features by column."""
    out = np.zeros((len(codes), turned.shape[1]))
    for i in range(0, len(codes), 512):
        part = codes[i : i + 512]
        norm = np.full(len(part), 1e-9)
        total = np.zeros((len(part), turned.shape[1]))
        for bucket, present, weight in features(part):
            for j in range(bucket.shape[1]):
                total += turned[bucket[:, j]] * (weight * present[:, j, None])
            norm += weight * weight * present.sum(axis=1)
        out[i : i + 512] = total / np.sqrt(norm)[:, None]
    return out


def disguised(codes: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """The strings once with one character put in somewhere, and once with one after every character."""
    mark = np.frombuffer(b"-._*'x", np.uint8)
    out = np.zeros((2 * len(codes), codes.shape[1]), np.uint8)
    for i, row in enumerate(codes):
        letters = row[(row > 2)].tolist()
        if len(letters) < 3:
            out[2 * i] = out[2 * i + 1] = row
            continue
        at, sign = int(rng.integers(1, len(letters))), int(rng.choice(mark))
        one = [1, *letters[:at], sign, *letters[at:], 2]
        every = [1, *(x for c in letters for x in (c, int(mark[i % 4]))), 2]
        for line, new in ((2 * i, one), (2 * i + 1, every)):
            out[line, : len(new)] = new[: codes.shape[1]]
    return out


def machine(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-3) -> np.ndarray:
    """Linear machine with squared hinge loss, by Newton steps on the points inside the margin."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    keep = np.eye(len(w)) * ridge * weight.sum()
    keep[-1, -1] *= 1e-3
    for _ in range(25):
        active = y * (x @ w) < 1
        a = x[active] * weight[active, None]
        new = np.linalg.solve(a.T @ x[active] + keep, a.T @ y[active])
        if np.allclose(new, w, atol=1e-7):
            break
        w = new
    return w


@dataclass
class Model:
    weights: np.ndarray  # of each feature, for strings
    bias: float
    slope: float         # of the logistic curve
    offset: float
    sums: np.ndarray     # of each feature, for whole texts
    start: float         # value of a text without blamed strings

    def values(self, s: Strings, n_texts: int) -> np.ndarray:
        """Value of each text: its blamed strings add up, so no string makes a text better; beyond the margin all are alike."""
        values = evaluate(s.codes, self.weights) + self.bias
        pieces, string, text = s.blamed(values)
        worth = np.maximum(evaluate(s.codes[pieces], self.sums), 0) * np.minimum(values[pieces], 1)
        return np.minimum(self.start + np.bincount(text, worth[string], minlength=n_texts), 1)

    def scores(self, values: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * values + self.offset, -60, 60)))


def curve(values: np.ndarray, toxic: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the logistic curve, with targets drawn in from 0 and 1 by the class sizes."""
    many, few = toxic.sum(), (~toxic).sum()
    target = np.where(toxic, (many + 1) / (many + 2), 1 / (few + 2))
    x = np.stack([values, np.ones(len(values))], axis=1)
    w = np.zeros(2)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        bend = (x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        step = np.linalg.solve(bend, x.T @ (target - p) - 1e-3 * w)
        w += step * min(1.0, 5 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-6:
            break
    return float(w[0]), float(w[1])


def gather(begins: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Places of all entries of the groups ``of``; group g has the entries from begins[g] to begins[g + 1]."""
    size = begins[of + 1] - begins[of]
    return np.repeat(begins[of] - np.cumsum(size) + size, size) + np.arange(size.sum())


def distinct_pairs(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    return a[new], b[new]


def runs_of(codes: np.ndarray, lengths: tuple[int, ...] = RUNS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(piece, hash) of every run of these lengths, some pieces at a time."""
    for first in range(0, len(codes), 1 << 15):
        wide = codes[first : first + (1 << 15)].astype(np.uint64)
        for n in lengths:
            run, present = np.zeros((len(wide), wide.shape[1] - n + 1), np.uint64), np.ones((len(wide), wide.shape[1] - n + 1), bool)
            for k in range(n):
                column = wide[:, k : k + run.shape[1]]
                run, present = run << np.uint64(8) | column, present & (column > 0)
            line, at = np.nonzero(present)
            yield first + line, T.mix(run[line, at] + np.uint64(n))


def odds(a: np.ndarray, b: np.ndarray, many: int, few: int) -> np.ndarray:
    """Log odds, less ``SURE`` standard errors, of what stands in ``a`` of ``many`` toxic and ``b`` of ``few`` clean texts."""
    found = np.log((a + 1) / (many + 2)) - np.log((b + 1) / (few + 2))
    return found - SURE * np.sqrt(1 / (a + 1) + 1 / (b + 1))


def _held(codes: np.ndarray, owner: np.ndarray, kept: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(string, number of the run) for every string and run of ``kept`` in it, each once, by string."""
    strings, numbers = [np.zeros(0, np.uint32)], [np.zeros(0, np.uint32)]
    for piece, run in runs_of(codes):
        number = np.minimum(np.searchsorted(kept, run), max(len(kept) - 1, 0))
        same = kept[number] == run if len(kept) else np.zeros(len(run), bool)
        string, number = distinct_pairs(owner[piece[same]].astype(np.uint32), number[same].astype(np.uint32))
        strings.append(string)
        numbers.append(number)
    # the pieces of a string may fall into two blocks
    return distinct_pairs(np.concatenate(strings), np.concatenate(numbers))


def _candidates(codes: np.ndarray, owner: np.ndarray, texts_of: np.ndarray, least: int, barred: np.ndarray | None = None) -> np.ndarray:
    """Runs, ascending, of strings in toxic texts that can stand in ``least`` of these; without those of barred strings.

    ``texts_of`` counts the toxic texts of each string. Their sum over the strings with a run is at least its number of
    texts. One length at a time, so that only the runs of one are held together.
    """
    out = [np.zeros(0, np.uint64)]
    suspect = np.flatnonzero(texts_of[owner] > 0)
    bad = codes[barred[owner]] if barred is not None else codes[:0]
    for n in RUNS:
        runs, most = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for piece, run in runs_of(codes[suspect], (n,)):
            string, run = distinct_pairs(owner[suspect[piece]], run)
            both, place = np.unique(np.concatenate([runs, run]), return_inverse=True)
            most = np.bincount(place, np.concatenate([most, texts_of[string]]), len(both)).astype(np.int64)
            runs = both
        runs = runs[most >= least]
        for _, run in runs_of(bad, (n,)):
            runs = runs[~np.isin(runs, run)]
        out.append(runs)
    return np.unique(np.concatenate(out))


def seeded(codes: np.ndarray, owner: np.ndarray, s: Strings, toxic: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """To begin with: log odds of each piece's best seed (zero without), which strings hold a seed, and a clear one.

    Seeds are runs that stand in more toxic than clean texts, beyond chance. They are taken one by one; strings with
    a seed are then left out of the counts, until no run is left that is beyond chance in the others. A seed is clear
    if nearly all its texts are toxic. Runs that stand in too few toxic texts to be beyond chance are never held.
    """
    n_strings, many, few = int(owner.max()) + 1, int(toxic.sum()), int((~toxic).sum())
    pairs = np.unique(s.text.astype(np.int64) * n_strings + s.string)
    in_text, string_of = pairs // n_strings, pairs % n_strings
    del pairs
    texts_of = np.bincount(string_of[toxic[in_text]], minlength=n_strings)
    cut = np.searchsorted(in_text, np.arange(len(toxic) + 1))
    clean_texts = np.arange(few + 1)
    least = next((a for a in range(1, many + 1) if (odds(np.float64(a), clean_texts, many, few) > 0).any()), many + 1)

    def counted(kept: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        of_pair, of_string = _held(codes, owner, kept)
        begins = np.searchsorted(of_pair, np.arange(n_strings + 1))
        in_toxic, in_clean = np.zeros(len(kept), np.int64), np.zeros(len(kept), np.int64)
        for i in range(len(toxic)):
            runs = np.unique(of_string[gather(begins, string_of[cut[i] : cut[i + 1]])])
            (in_toxic if toxic[i] else in_clean)[runs] += 1
        return of_pair, of_string, begins, in_toxic, in_clean

    value, holds, strong = np.zeros(len(codes)), np.zeros(n_strings, bool), np.zeros(n_strings, bool)
    kept = _candidates(codes, owner, texts_of, least)
    of_pair, of_string, begins, in_toxic, in_clean = counted(kept)
    likely = odds(in_toxic, in_clean, many, few) > 0
    few_texts = not likely.any()
    if few_texts:  # too few for that: the commonest of those that no clean text has
        clean = np.zeros(n_strings, bool)
        clean[string_of[~toxic[in_text]]] = True
        kept = _candidates(codes, owner, texts_of, 1, clean)
        of_pair, of_string, begins, in_toxic, in_clean = counted(kept)
        likely = in_toxic == in_toxic.max(initial=1)
    known = len(kept)
    if not known:
        return value, holds, strong
    held, which = np.unique(of_pair[likely[of_string]]), of_string[likely[of_string]]
    begins = np.searchsorted(of_pair[likely[of_string]], np.arange(n_strings + 1))
    with_any = np.zeros(n_strings, bool)
    with_any[held] = True
    seen = with_any[string_of]
    text, string = in_text[seen], string_of[seen]
    size = np.diff(begins)[string]
    text, string, run = np.repeat(text, size), np.repeat(string, size), which[gather(begins, string)].astype(np.int64)
    seeds = np.zeros(known, bool)
    while len(run):
        once = np.unique(text * known + run)
        a, b = (np.bincount(once[x] % known, minlength=known) for x in (toxic[once // known], ~toxic[once // known]))
        gain = a * (1.0 if few_texts else np.maximum(odds(a, b, many, few), 0))
        best = gain.argmax()
        if gain[best] <= 0:
            break
        seeds[best] = True
        done = np.zeros(n_strings, bool)
        done[string[run == best]] = True
        left = ~done[string]
        text, string, run = text[left], string[left], run[left]
    strength = np.ones(known) if few_texts else np.maximum(odds(in_toxic, in_clean, many, few), 1e-3)
    clear = seeds & ((in_toxic + 1) >= CLEAR * (in_toxic + in_clean + 1))
    chosen = np.flatnonzero(seeds)
    for piece, run in runs_of(codes):
        at = np.minimum(np.searchsorted(kept[chosen], run), len(chosen) - 1) if len(chosen) else np.zeros(0, np.int64)
        same = kept[chosen[at]] == run if len(chosen) else np.zeros(len(run), bool)
        piece, seed = piece[same], chosen[at[same]] if len(chosen) else chosen
        np.maximum.at(value, piece, strength[seed])
        holds[owner[piece]] = True
        strong[owner[piece[clear[seed]]]] = True
    return value, holds, strong


def fit(texts: list[str], toxic: np.ndarray) -> Model:
    """Train on whole texts and their labels."""
    nothing = Model(np.zeros(SIZE, np.float32), 0.0, 0.0, 2.0 if len(toxic) and toxic.all() else -2.0, np.zeros(SIZE, np.float32), 0.0)
    if not toxic.any() or toxic.all():
        return nothing
    s = all_strings(texts)
    if not len(s.codes):
        return nothing
    rng = np.random.default_rng(7)
    clean_strings = np.zeros(s.owner.max() + 1, bool)
    clean_strings[s.string[~toxic[s.text]]] = True
    values, holds, strong = seeded(s.codes, s.owner, s, toxic)
    # a string of clean texts can be to blame only if it holds a seed; then it is no example of a clean one
    barred = clean_strings & ~holds
    negatives = np.flatnonzero(barred[s.owner])
    turned = root = None
    model = nothing
    for turn in range(ROUNDS):
        # the worst pieces of each toxic text: at first all with a seed, then the worst one, and those not far behind
        by_string = np.full(s.owner.max() + 1, -np.inf)
        np.maximum.at(by_string, s.owner, np.where(barred[s.owner], -np.inf, values))
        bags = toxic[s.text]
        worst = np.full(len(texts), -np.inf)
        np.maximum.at(worst, s.text[bags], by_string[s.string[bags]])
        near = by_string[s.string] > 0 if turn == 0 else by_string[s.string] >= np.maximum(worst[s.text] - 0.5, 0.0)
        pairs = np.unique(s.text[bags & near].astype(np.int64) * len(by_string) + s.string[bags & near])
        texts_of = np.bincount(pairs % len(by_string), minlength=len(by_string))  # toxic texts a string was chosen in
        positive = np.flatnonzero((texts_of[s.owner] > 0) & (values >= by_string[s.owner]))
        if not len(positive) or not len(negatives):
            break
        positive = rng.permutation(positive)
        positive = positive[np.argsort(-texts_of[s.owner[positive]], kind="stable")][:FIT_STRINGS]
        often = texts_of[s.owner[positive]]
        hard = negatives[np.argsort(-values[negatives], kind="stable")[: FIT_STRINGS // 2]]
        plain = rng.permutation(negatives)[: FIT_STRINGS // 2]
        negative = np.unique(np.concatenate([hard, plain]))
        if turned is None:
            marks = np.concatenate([positive[: LANDMARKS * 2 // 3], plain[: LANDMARKS // 3]])
            turned = matrix(s.codes[marks])
            value, vector = np.linalg.eigh((turned.T @ turned).astype(float))
            good = value > 1e-6 * value.max()
            root = vector[:, good] / np.sqrt(value[good])
        hidden = disguised(s.codes[positive[: FIT_STRINGS // 4]], rng)
        x = kernel(np.concatenate([s.codes[positive], hidden, s.codes[negative]]), turned) @ root
        y = np.concatenate([np.ones(len(positive) + len(hidden)), -np.ones(len(negative))])
        share = np.concatenate([
            0.4 * often / often.sum(), 0.1 * np.repeat(often[: FIT_STRINGS // 4], 2) / (2 * often[: FIT_STRINGS // 4].sum()),
            np.full(len(negative), 0.5 / len(negative)),
        ])
        w = machine(x, y, share)
        model = Model((turned @ (root @ w[:-1])).astype(np.float32), float(w[-1]), 1.0, 0.0, nothing.sums, 0.0)
        values = evaluate(s.codes, model.weights) + model.bias
    if turned is None:
        return nothing
    model.sums, model.start = _sums(s, model, strong, toxic, turned, root, rng)
    model.slope, model.offset = curve(model.values(s, len(texts)), toxic)
    return model


def _sums(s: Strings, model: Model, strong: np.ndarray, toxic: np.ndarray, turned: np.ndarray, root: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, float]:
    """Weights and bias of the machine for whole texts; a text is the sum of its blamed strings, each by its value.

    Each strong string is learned as a toxic text of its own too, as it is and in disguise.
    """

    def valued(codes: np.ndarray) -> np.ndarray:
        return kernel(codes, turned) @ root * np.clip(evaluate(codes, model.weights) + model.bias, 0, 1)[:, None]

    blamed, string, text = s.blamed(evaluate(s.codes, model.weights) + model.bias)
    each = valued(s.codes[blamed])
    x = np.zeros((len(toxic), each.shape[1]))
    np.add.at(x, text, each[string])
    pairs = np.unique(text[toxic[text]] * len(blamed) + string[toxic[text]])
    often = np.bincount(pairs % len(blamed), minlength=len(blamed)) * strong[s.owner[blamed]] if len(blamed) else np.zeros(0)
    own = np.flatnonzero(often)
    often = often[own] / max(1, often.sum())
    x = np.concatenate([x, each[own], valued(disguised(s.codes[blamed[own]], rng))])
    y = np.concatenate([np.where(toxic, 1.0, -1.0), np.ones(3 * len(own))])
    weight = np.concatenate([np.where(toxic, 0.4 / toxic.sum(), 0.5 / (~toxic).sum()), 0.04 * often, 0.03 * np.repeat(often, 2)])
    w = machine(x, y, weight, 1e-4)
    return (turned @ (root @ w[:-1])).astype(np.float32), float(w[-1])


def fit_on_labels(docs: DataFrame, labels: DataFrame, held_out: Column) -> Model:
    """Train on at most ``FIT_TEXTS`` labelled texts of each class, those of lowest hash; held-out rows are left out.

    A document labelled several times counts as toxic if any of them says so.
    """
    marked = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    order = [F.xxhash64("doc_id", F.lit(3)), F.col("doc_id")]
    sample = [marked.where(F.col("toxic") > 0), marked.where(F.col("toxic") <= 0)]
    sample = sample[0].orderBy(*order).limit(FIT_TEXTS).unionByName(sample[1].orderBy(*order).limit(FIT_TEXTS))
    # twice FIT_TEXTS ids at most; a single task fits, so that the driver holds no texts
    rows = (
        docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").where(F.length("text") > 0)
        .dropDuplicates(["doc_id"]).select("text", (F.col("toxic") > 0).alias("toxic"))
    )
    found = rows.groupBy(F.lit(1).alias("one")).applyInArrow(_fit_rows, "weights binary, bias double, slope double, offset double, sums binary, start double").collect()
    if not found:
        return fit([], np.zeros(0, bool))
    weights, bias, slope, offset, sums, start = found[0]
    return Model(np.frombuffer(bytes(weights), np.float32), bias, slope, offset, np.frombuffer(bytes(sums), np.float32), start)


def _fit_rows(rows: pa.Table) -> pa.Table:
    marked = sorted(set(zip(rows.column("text").to_pylist(), rows.column("toxic").to_pylist())))
    model = fit([text for text, _ in marked], np.array([toxic for _, toxic in marked], bool))
    return pa.table({"weights": [model.weights.tobytes()], "bias": [model.bias], "slope": [model.slope], "offset": [model.offset], "sums": [model.sums.tobytes()], "start": [model.start]})


def _scorer(model: Model, text_in: str | None = None):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if text_in:
                texts, kept, names = pc.struct_field(batch.column(text_in), "text"), batch.columns, batch.schema.names
            else:
                texts, kept, names = batch.column(0), batch.columns[1:], batch.schema.names[1:]
            for first, last, data, at in T.chunks(texts, FIT_BYTES):
                found = model.scores(model.values(strings(data, at), last - first))
                yield pa.RecordBatch.from_arrays([*(c[first:last] for c in kept), pa.array(found)], [*names, "score"])

    return score


def with_score(docs: DataFrame, model: Model, *columns: str, text_in: str | None = None) -> DataFrame:
    """``columns`` of every row of ``docs``, and its toxicity as ``score``; the text is only read.

    ``text_in`` names the one of them, a struct, that holds the text, so that no text is sent to Python twice.
    """
    schema = docs.select(*columns).schema.add("score", "double")
    sent = docs.select(*([] if text_in else [F.col("text").alias("__text")]), *columns)
    return sent.mapInArrow(_scorer(model, text_in), schema)


def score_toxicity(docs: DataFrame, labels: DataFrame, held_out: Column) -> DataFrame:
    """One row per row of ``docs``: ``score`` from 0 to 1, and 1 from 0.5 up in ``predicted``.

    Null and empty texts, and texts without letters or digits, get the score of a text without strings, which is low.
    Without labels of both classes all texts get the same score. Repeated rows are scored each on their own.
    """
    model = fit_on_labels(docs, labels, held_out)
    return with_score(docs.withColumn("held_out", held_out), model, "doc_id", "held_out").withColumn(
        "predicted", (F.col("score") >= 0.5).cast("int")
    )
