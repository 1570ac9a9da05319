"""Toxicity by a subsequence string-kernel support vector machine with Nyström landmarks.

The kernel counts common subsequences of four letters, each weighted by ``DECAY`` for every letter it
spans, so that gaps and inserted characters weaken a match but don't end it. Words are the strings; a sentence is as
toxic as its worst word. Landmarks (at most ``MAX_LANDMARKS``, taken greedily) are strings that more toxic texts have
than chance would give, and some common clean words; the kernel against them, whitened by the landmarks' own
kernel matrix (Nyström), feeds a linear support vector machine, which is trained on the labelled sentences: those of
toxic texts that it names itself, in turns, against those of clean texts. Its weights fold back into one weight for
each subsequence that a landmark has, a table that is broadcast. A text scores as its two worst words
do, and a sigmoid fitted to labelled texts makes that a probability.

The machine is fitted in one task to a bounded sample: ``MAX_TRAIN`` labelled texts of at most
``MAX_CHARS`` characters, chosen by a hash of their id. Scoring reads whole texts and has no shuffle.

Defined cases: null, empty or wordless texts score as texts without any match; labels that are null are left
out, and a text with several labels is toxic if one says so; of a labelled id that repeats, one text is learnt from;
without labels of both kinds every text scores 0, without any landmark as label 1 is frequent; very long texts are
scored whole, long words in pieces that overlap; repeated rows score alike, so there are no ties to break; extra
columns are carried along, but for those that are added; an empty table gives an empty result.
"""

from __future__ import annotations

import pickle
import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

MAX_TRAIN, MAX_CHARS = 4000, 50_000
DECAY, SPAN, WIDTH, DENSE, CACHED = 0.7, 7, 32, 1 << 23, 250_000
MAX_LANDMARKS, CLEAN_LANDMARKS, NEGATIVES, TURNS = 256, 16, 9000, 4

_NOT_LETTERS = re.compile(r"[\W\d_]+")
_SPELLED = re.compile(r"(?<!\S)(?:[^\W\d_]\W{0,3}\s+){3,}[^\W\d_](?!\S)")
_SENTENCE = re.compile(r"[.!?\n]+(?=\s|$)")


def strings(text: str, words: dict[str, str] | None = None) -> Counter:
    """Words without what isn't a letter, behind a start mark; letters that stand alone in a row are also joined.

    ``words`` keeps one copy of each word for many texts."""
    low = text.lower()
    out: Counter = Counter()
    for x, n in Counter(low.split()).items():
        if word := _NOT_LETTERS.sub("", x):
            out["^" + word] += n
    for x in _SPELLED.findall(low):
        out["^" + _NOT_LETTERS.sub("", x)] += 1
    return out if words is None else Counter({words.setdefault(w, w): n for w, n in out.items()})


def _encode(words: list[str], alphabet: np.ndarray) -> np.ndarray:
    """Letters as their places in the sorted alphabet from 1 on, one number more for all others, 0 behind the end; rows are WIDTH long."""
    flat = np.frombuffer("".join(w.ljust(WIDTH, "\0") for w in words).encode("utf-32-le"), np.uint32).reshape(len(words), WIDTH)
    at = np.minimum(np.searchsorted(alphabet, flat), len(alphabet) - 1)
    return np.where(flat == 0, 0, np.where(alphabet[at] == flat, at + 1, len(alphabet) + 1)).astype(np.int64)


def alphabet_of(words: list[str]) -> np.ndarray:
    """Letters of any script that the landmarks have. Others can't be part of a common subsequence, but take up room in a gap."""
    return np.unique(np.frombuffer("".join(words).encode("utf-32-le"), np.uint32))


def _pieces(word: str) -> list[str]:
    """Words longer than WIDTH, in pieces that overlap by what a subsequence may span."""
    return [word] if len(word) <= WIDTH else [word[k : k + WIDTH] for k in range(0, len(word) - SPAN + 1, WIDTH - SPAN + 1)]


def _subsequences(codes: np.ndarray, base: int) -> Iterator[tuple[np.ndarray, float]]:
    """For each choice of gaps: numbers of the subsequences (0 if cut off by the end), and their weight."""
    for a, b, c in combinations(range(1, SPAN), 3):
        i, j, k, m = (codes[:, x : WIDTH - c + x] for x in (0, a, b, c))
        yield np.where(m > 0, ((i * base + j) * base + k) * base + m, 0), DECAY ** (c - 3)


class Table:
    """Values of the subsequences that the landmarks have, by number: as an array of all numbers, if that is small."""

    def __init__(self, alphabet: np.ndarray, numbers: np.ndarray, values: np.ndarray, missing: float):
        self.alphabet, self.base, self.numbers, self.values, self.missing = alphabet, len(alphabet) + 2, numbers, values, missing
        self.dense = None
        if self.base**4 <= DENSE:
            self.dense = np.full(self.base**4, missing, values.dtype)
            self.dense[numbers] = values

    def __getitem__(self, number: np.ndarray) -> np.ndarray:
        if self.dense is not None:
            return self.dense[number]
        at = np.minimum(np.searchsorted(self.numbers, number), len(self.numbers) - 1)
        return np.where(self.numbers[at] == number, self.values[at], self.missing)


def decide(table: Table, words: list[str]) -> np.ndarray:
    """Sum of the weights of a word's subsequences (the highest, of a long word's pieces)."""
    parts = [(k, p) for k, w in enumerate(words) for p in _pieces(w)]
    out = np.full(len(words), -np.inf)
    for lo in range(0, len(parts), 8192):
        some = parts[lo : lo + 8192]
        longest = max(len(p) for _, p in some)
        codes = _encode([p for _, p in some], table.alphabet).astype(np.int64 if table.dense is None else np.int32)
        got = np.zeros(len(some))
        for number, weight in _subsequences(codes, table.base):
            got += weight * table[number[:, : max(1, longest)]].sum(axis=1)
        np.maximum.at(out, [k for k, _ in some], got)
    return out


def _features(words: list[str], index: Table) -> np.ndarray:
    """Weights of the indexed subsequences in each word of at most WIDTH letters."""
    codes, out = _encode(words, index.alphabet), np.zeros((len(words), len(index.numbers)), np.float32)
    rows = np.arange(len(words))[:, None]
    for number, weight in _subsequences(codes, index.base):
        at = index[number]
        hit = at >= 0
        np.add.at(out, (np.broadcast_to(rows, at.shape)[hit], at[hit]), weight)
    return out


def _seen_by(words: list[str], index: Table, landmarks: np.ndarray) -> np.ndarray:
    """Features of the words against columns of ``landmarks``, some words at a time."""
    return np.vstack([_features(words[lo : lo + 1024], index) @ landmarks for lo in range(0, len(words), 1024)])


def _distinct(texts: list[str]) -> np.ndarray:
    """Places of the texts without most near copies: of those with one smallest shingle the first stays."""
    seen: set[int] = set()
    out = []
    for k, text in enumerate(texts):
        w = text.lower().split()
        codes = [zlib.crc32(" ".join(w[i : i + 5]).encode()) for i in range(max(1, len(w) - 4))]
        marks = {min(codes), (1 << 32) + max(codes)}
        if not marks & seen:
            out.append(k)
        seen |= marks
    return np.array(out)


def _substrings(words: list[str]) -> Iterator[tuple[int, str]]:
    for k, w in enumerate(words):
        for n in range(4, 9):
            for i in range(len(w) - n + 1):
                yield k, w[i : i + n]


def _landmarks(bags: list[Counter], toxic: np.ndarray) -> list[str]:
    """Strings that more toxic texts have than chance would give: parts of words that no clean text has, and
    beginnings of any words. One after the other the most frequent is taken, and the words that hold it are set aside.

    They are landmarks only; which words and sentences are toxic is left to the machine."""
    clean = set().union(*[b for b, t in zip(bags, toxic) if not t])
    holders: dict[str, set[int]] = defaultdict(set)
    for k in np.flatnonzero(toxic):
        for w in bags[k]:
            holders[w].add(k)
    new = [w for w in holders if w not in clean]
    share, n_parts = toxic.mean(), sum(max(0, len(w) - n + 1) for w in new for n in range(4, 9))
    # so many texts that not one of all the substrings would be in toxic ones alone by chance
    least = max(2, int(np.ceil(np.log(20 * max(1, n_parts)) / -np.log(share))))
    # counted by hashes first: few substrings are that frequent
    weight = np.zeros(1 << 22, np.int32)
    for k, p in _substrings(new):
        weight[hash(p) & (len(weight) - 1)] += len(holders[new[k]])
    often = weight >= least
    parts: dict[str, set[str]] = defaultdict(set)
    for k, p in _substrings(new):
        if often[hash(p) & (len(often) - 1)]:
            parts[p].add(new[k])
    for _, p in _substrings(sorted(clean)):
        parts.pop(p, None)
    first = Counter(w[:n] for w in holders for n in range(5, 9) for _ in range(len(holders[w])))
    first = {p for p, n in first.items() if n >= least}
    in_clean = Counter(p for b, t in zip(bags, toxic) if not t for p in {w[:n] for w in b for n in range(5, 9)} & first)
    for w in holders:
        for n in range(5, 9):
            if w[:n] in first:
                parts[w[:n]].add(w)

    def size(words: set[str]) -> int:
        return len(set().union(*[holders[w] for w in words]))

    enough = lambda p, n: n >= max(least, 12 * in_clean[p] * share / (1 - share))
    sizes = {p: n for p, ws in parts.items() if enough(p, n := size(ws))}
    chosen: list[str] = []
    while sizes and len(chosen) < MAX_LANDMARKS:
        top = max(sizes.values())
        best = max((p for p in sizes if sizes[p] >= 0.85 * top), key=lambda p: (len(p), sizes[p], p))
        chosen.append(best)
        gone = set(parts[best])
        for p in [p for p in sizes if not parts[p].isdisjoint(gone)]:
            parts[p] = parts[p] - gone
            sizes[p] = size(parts[p])
            if not enough(p, sizes[p]):
                del sizes[p]
    return chosen


def _svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, c: float = 1e6) -> tuple[np.ndarray, float]:
    """Linear machine with squared hinge loss, by Newton steps over the examples inside the margin."""
    z = np.hstack([x, np.ones((len(x), 1))]).astype(np.float64)
    w, ridge = np.zeros(z.shape[1]), np.diag(np.r_[np.ones(z.shape[1] - 1), 1e-3])
    for _ in range(40):
        inside = y * (z @ w) < 1
        some, pull = z[inside], weight[inside]
        new = np.linalg.solve(ridge + 2 * c * (some * pull[:, None]).T @ some, 2 * c * some.T @ (pull * y[inside]))
        if np.allclose(new, w, atol=1e-6):
            break
        w = (w + new) / 2 if _ > 10 else new
    return w[:-1], float(w[-1])


def _worst(bag: Counter, known: dict[str, float]) -> tuple[float, float]:
    """The highest score of a text's words, and the highest of the rest of them."""
    one = two = 0.0
    for w, n in bag.items():
        if (f := known[w]) > one:
            one, two = f, (f if n > 1 else one)
        elif f > two:
            two = f
    return one, two


def _sigmoid_fit(f: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """Weights of the two scores and an offset for the probability of ``toxic``, with softened targets."""
    up, down = toxic.sum(), (~toxic).sum()
    target = np.where(toxic, (up + 1) / (up + 2), 1 / (down + 2))
    x, w = np.hstack([f, np.ones((len(f), 1))]), np.zeros(f.shape[1] + 1)
    ridge = np.r_[np.full(f.shape[1], 1e-2), 1e-4]
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        h = (x * np.maximum(p * (1 - p), 1e-6)[:, None]).T @ x + np.diag(ridge)
        w = w - np.clip(np.linalg.solve(h, x.T @ (p - target) + ridge * w), -3, 3)
    return w


def fit(texts: list[str], toxic: np.ndarray) -> dict | None:
    """The machine: a weight for each subsequence, a bias, and a sigmoid. Without labels of both kinds None; without
    any landmark every text scores as frequent as label 1 is.

    A toxic label says that a text has a toxic sentence, not which. So the machine is fitted in turns: in each it names
    the sentences of toxic texts that it holds for toxic, by the words that make them so, and learns these against the
    words of clean texts anew. It begins with the landmarks themselves."""
    if toxic.all() or not toxic.any():
        return None
    own = _distinct(texts)
    texts, toxic = [texts[k] for k in own], toxic[own]
    once: dict[str, str] = {}
    bags = [strings(t, once) for t in texts]
    insults = _landmarks(bags, toxic)
    if not insults:
        rate = (toxic.sum() + 0.5) / (len(toxic) + 1)
        return {"table": None, "bias": 0.0, "sigmoid": np.array([0.0, 0.0, np.log(rate / (1 - rate))]), "landmarks": []}
    counts = Counter(w for b, t in zip(bags, toxic) if not t for w in b)
    clean = sorted(counts, key=lambda w: (-counts[w], w))
    sentences = [sorted(strings(x, once)) for t, bad in zip(texts, toxic) if bad for x in _SENTENCE.split(t)]
    doubtful = sorted(set().union(*sentences))
    marks = insults + [w for w in clean if 5 <= len(w) <= 13][:CLEAN_LANDMARKS]
    alphabet = alphabet_of(marks)
    numbers = np.unique(np.concatenate([n.ravel() for n, _ in _subsequences(_encode(marks, alphabet), len(alphabet) + 2)]))
    numbers = numbers[numbers > 0]
    index = Table(alphabet, numbers, np.arange(len(numbers)), -1)
    phi = _features(marks, index).astype(np.float64)
    norm = np.linalg.norm(phi, axis=1)
    phi /= norm[:, None]
    value, vector = np.linalg.eigh(phi @ phi.T)
    root = vector @ np.diag(np.where(value > 1e-6, value, np.inf) ** -0.5) @ vector.T
    scale = 1 / np.median((_features(insults, index) @ phi[: len(insults)].T).max(axis=1))
    basis = phi.T @ root * scale
    spread = clean[: NEGATIVES // 2] + clean[NEGATIVES // 2 :: max(1, 2 * len(clean) // NEGATIVES)]
    spread = [p for w in spread for p in _pieces(w)]
    positive = set(insults)
    for turn in range(TURNS):
        strings_ = sorted({p for w in positive for p in _pieces(w)})
        # strings that resemble one landmark count together as much as those of any other
        of = _seen_by(strings_, index, phi[: len(insults)].T).argmax(axis=1)
        share = np.bincount(of, minlength=len(insults))
        weigh = 0.5 / (share > 0).sum() / share[of]
        x = _seen_by(strings_ + spread, index, basis)
        w, bias = _svm(x, np.r_[np.ones(len(strings_)), -np.ones(len(spread))], np.r_[weigh, np.full(len(spread), 0.5 / len(spread))])
        table = Table(alphabet, numbers, (basis @ w).astype(np.float32), 0.0)
        if turn == TURNS - 1:
            break
        # the clean words that come closest join the negative ones; toxic sentences are named anew
        near = decide(table, clean)
        spread = list(dict.fromkeys(spread + [p for k in np.argsort(-near)[:2000] for p in _pieces(clean[k])]))
        worst = dict(zip(doubtful, decide(table, doubtful)))
        positive = set(insults) | {v for words in sentences for v in words if worst[v] + bias > 0 and v not in counts}
    score = dict(zip(clean, decide(table, clean))) | dict(zip(other := sorted(set().union(*bags) - counts.keys()), decide(table, other)))
    sigmoid = _sigmoid_fit(np.array([_worst(b, score) for b in bags]), toxic)
    return {"table": (alphabet, numbers, table.values, 0.0), "bias": bias, "sigmoid": sigmoid, "landmarks": insults, "marks": marks, "alpha": root @ w * scale / norm}


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> dict | None:
    """The machine for a bounded sample of the labelled texts."""
    chosen = labels.filter(F.col(label_col).isNotNull()).groupBy(id_col).agg(F.max(label_col).alias("y")).orderBy(F.xxhash64(id_col), id_col).limit(MAX_TRAIN)
    rows = docs.join(F.broadcast(chosen), id_col).filter(F.length(text_col) <= MAX_CHARS).select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").alias("text"), (F.col("y") == 1).alias("toxic"))
    first = rows.groupBy("id").agg(F.min_by(F.struct("text", "toxic"), F.xxhash64("text")).alias("row")).select("id", "row.*")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sample = sorted(row for x in batches for row in zip(*(c.to_pylist() for c in x.columns)))
        model = fit([t for _, t, _ in sample], np.array([y for *_, y in sample], bool)) if sample else None
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], names=["model"])

    # one task fits the machine to the sample, whose size the parameters bound; only the machine comes to the driver
    made = first.repartition(1).mapInArrow(work, "model binary").collect()
    return pickle.loads(bytes(made[0]["model"])) if made else None


def score(df: DataFrame, model: dict | None, text_col: str = "text") -> DataFrame:
    """``df`` with ``score`` (0 to 1) and ``predicted`` (1 from 0.5 on)."""
    df = df.drop("score", "predicted")
    shared = df.sparkSession.sparkContext.broadcast(model)
    at = df.columns.index(text_col)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine, known = shared.value, {}
        table = Table(*machine["table"]) if machine and machine["table"] else None
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                if machine is None:
                    out = np.zeros(part.num_rows)
                else:
                    bags = [strings(t or "") for t in part.column(at).to_pylist()] if table else [Counter()] * part.num_rows
                    new = sorted(set().union(*bags) - known.keys(), key=len)
                    if new:
                        known.update(zip(new, decide(table, new).tolist()))
                    f = np.array([(*_worst(b, known), 1.0) for b in bags])
                    out = 1 / (1 + np.exp(-np.clip(f @ machine["sigmoid"], -40, 40)))
                    if len(known) > CACHED:
                        known.clear()
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(out), pa.array((out >= 0.5).astype(np.int32))], names=[*part.schema.names, "score", "predicted"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.mapInArrow(work, f"{schema}, score double, predicted int")


def held_out(id_col: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(False))


def op9_toxicity(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    model = train(docs, labels.filter(~held_out()))
    return score(docs.select("doc_id", "text"), model).select("doc_id", held_out().alias("held_out"), "score", "predicted")
