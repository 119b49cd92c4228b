"""Text cut off by field limits or in transfer."""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import WHITE_SPACE
from ..operators.common import small_join, take
from ..session import arrow_map, settled

#: Texts (in expectation) that are trained on as one part, all parts being trained on; artificial cuts made of each text; folds for cross-fitting.
PART, CUTS, FOLDS = 20_000, 8, 3
#: Rounds of training, passes over all texts a round, and how often a round the parts' models are mixed.
ROUNDS, PASSES, MIXES = 3, 14, 2
#: Logits are counted in steps of one in so many; numbers of a vector that travel as one row.
STEPS, BLOCK = 1024, 1 << 14
#: Lengths on either side that a length's hazard is compared with; share of false limits; least distinct texts at a limit.
NEAR, FALSE_SHARE, LEAST_TEXTS = 40, 0.01, 4
#: What a limit's excess counts as at most, and at least one minus it.
SURE = 0.95
#: Properties are hashed into so many bits; those of fewer examples than this tell nothing.
BITS, SUPPORT = 18, 4

# Marks that programs put where they cut a text.
MARKER = re.compile(r"\s?(?:\.{3,}|…|\[(?:\.{3}|…|more|cut|truncated|continued)\]|\((?:\.{3}|…|more|cut|truncated|continued)\))\Z", re.I)

_WORD = re.compile(r"[^\W\d_]+")
#: In this order no later step leaves a pair that an earlier one has removed.
_PAIRS = [(p, p[0]) for p in ("aaaa", "aa", "Aa", "AA", "aA", "00", "  ")]
_HEX = re.compile(r"(?<![0-9A-Za-z])(?=[a-f]*\d)[0-9a-f]{6,}(?![0-9A-Za-z])")
_SIX = re.compile("[0-9a-f]{6}")
_DIGIT, _STOP = re.compile(r"\d"), re.compile(r"[.!?。！？]\s|[。！？]|\n")


def _hash(s: str) -> int:
    return zlib.crc32(s.encode("utf-8", "surrogatepass")) & ((1 << BITS) - 1)


class _Kinds(dict):
    """Of a character's number: A for capitals, a for other letters, 0 for digits, a blank for white space, else itself."""

    def __missing__(self, number: int) -> str:
        c = chr(number)
        kind = " " if c.isspace() else "0" if c.isdecimal() else c if not _WORD.match(c) else "A" if c.isupper() else "a"
        self[number] = kind
        return kind


_KINDS = _Kinds()


def _shape(s: str) -> str:
    """Runs of letters as a (A with a capital first), of digits as 0, of white space as one blank; the rest as it is."""
    s = s.translate(_KINDS)
    for pair, one in _PAIRS:
        while pair in s:
            s = s.replace(pair, one)
    return s


#: The pieces of a text begin alike.
_shape_of_first = lru_cache(maxsize=16)(_shape)


def _plain_hex(s: str) -> str:
    """Stretches of hexadecimal digits by their length."""
    return _HEX.sub(lambda m: f"<{len(m[0])}>", s) if _SIX.search(s) else s


def _last_stop(s: str) -> int:
    """Where the last sentence or line of a text begins; 0 if it is the first. Looked for in the whole text, from its end."""
    width = 256
    while True:
        start = max(0, len(s) - width)
        at = 0
        for m in _STOP.finditer(s, start, len(s) - 1):
            at = m.end()
        if at or not start:
            return at
        width *= 8


def _bucket(x: float) -> int:
    return int(math.log2(x + 1) * 2)


def _last_word(s: str) -> str | None:
    m = _WORD.match(s[:-61:-1])
    return m[0][::-1] if m else None


def ending(text: str) -> tuple[list[int], str | None]:
    """Hashed properties of how a text ends: its last characters and words, the shape of its last lines and how they go with its first one, and what is left open; and the letters it ends with, if any.

    Brackets are counted, and the beginnings of the last sentence and of the last two lines looked for, in the whole text. Of each of these, and of the end, a property is a
    stretch of fixed length: 1 to 10 characters, 1 to 4 words, 4 to 80 characters of a shape, the last 60 letters of the last word.
    """
    crc32, mask = zlib.crc32, (1 << BITS) - 1
    s = text.rstrip()
    tail = _plain_hex(s[-200:])
    plain = _DIGIT.sub("0", tail[-60:])
    lines = s.rsplit("\n", 2)
    line, before = lines[-1].strip(), (lines[-2].strip() if len(lines) > 1 else "")
    first = s.lstrip().split("\n", 1)[0]
    out = [f"c{k}{plain[-k:]}" for k in range(1, 11)]
    tokens = _DIGIT.sub("0", _plain_hex(line[-300:])).split()
    for k in (1, 2, 3, 4):
        out.append(f"w{k}" + " ".join(tokens[-k:]))
    shape, head = _shape(line[-160:]), (tokens[0][:24] if tokens else "")
    out += [f"p{k}{shape[-k:]}" for k in (4, 8, 12, 20)]
    out += [f"l{shape[:80]}", f"h{head}", f"hp{head}|{shape[-8:]}", f"hn{head}|{min(len(tokens), 12)}", f"hc{head}|{plain[-3:]}"]
    kind, opening = _shape_of_first(first[:60])[:24], _shape(before[-120:])[:24]
    out += [f"k{kind}|{shape[:24]}", f"kc{kind}|{plain[-1:]}", f"b{opening}|{shape[:30]}", f"kh{kind[:8]}|{head}", f"1{int(len(lines) == 1)}{plain[-1:]}"]
    open_ = [(a > b) - (a < b) for a, b in ((text.count(a), text.count(b)) for a, b in ("{}", "[]", "()", "«»"))]
    quotes = line.count('"') % 2
    out += [f"o{open_}{quotes}", f"oq{open_[:2]}{plain[-1:]}", f"q{quotes}{shape[-2:]}"]
    word = _last_word(s)
    if word is None:
        out.append(f"v-{plain[-1:]}")
    last = s[_last_stop(s) :]
    n = len(last.split(maxsplit=20))
    out += [f"n{min(n, 20)}|{plain[-1:] if not plain[-1:].isalnum() else 'a'}", f"t{_shape(last[:600])[:60]}"]
    return [crc32(x.encode("utf-8", "surrogatepass")) & mask for x in out], word


def word_features(last: str, whole: int, longer: int) -> list[int]:
    """Hashed properties of a last word: whether it is one or the beginning of one, by how often the corpus has it alone and as a longer word's beginning."""
    ratio = int(2 * math.log2((whole + 0.3) / (longer + 0.3)))
    out = [f"v{_bucket(whole)}", f"r{max(-12, min(12, ratio))}", f"vr{min(_bucket(whole), 8)}|{max(-6, min(6, ratio // 2))}", f"vl{len(last)}|{min(_bucket(whole), 6)}"]
    return [_hash(x) for x in out]


def features(text: str, words: dict[str, tuple[int, int]]) -> list[int]:
    """All hashed properties of a text's end."""
    out, last = ending(text)
    return out if last is None else out + word_features(last, *words.get(last, (0, 0)))


def cut_at_random(text: str, rng: np.random.Generator) -> str:
    """A text cut at an even place before its last character; where the next character has several bytes, one time in four with the sign of a broken one."""
    n = len(text.rstrip())
    at = int(rng.integers(1, max(2, n)))
    broken = text[at : at + 1] > "\x7f" and rng.random() < 0.25
    return text[:at] + ("�" if broken else "")


def unmarked(text: str) -> tuple[str, bool]:
    """A text without the mark of a cut at its end, and whether there was one."""
    s = text.rstrip()
    end = max(0, len(s) - 40)
    m = MARKER.search(s, end)
    return (s[: m.start()], True) if m else (text, False)


def fold_of(text: str, folds: int) -> int:
    return zlib.crc32(text.encode("utf-8", "surrogatepass")) % folds


@dataclass
class EndModel:
    """Logistic models of artificially cut against real ends, one a fold, each fitted without the texts of its fold; the logit from which on an ending is taken for cut by itself; and the share of cuts that happen to look complete."""

    weights: np.ndarray
    bias: np.ndarray
    plain: float = 0.0
    complete: float = 0.0

    def of_ending(self, text: str) -> tuple[int, float, str | None]:
        """Of a text without mark: the model that hasn't seen it, its logit without the last word, over 0 the more it looks cut, and that word."""
        k = fold_of(text, len(self.bias))
        found, last = ending(text)
        return k, float(self.weights[k][np.array(found)].sum() + self.bias[k]), last

    def of_word(self, k: int, last: str, whole: int, longer: int) -> float:
        """What the last word adds to the logit of model k."""
        return float(self.weights[k][np.array(word_features(last, whole, longer))].sum())


def _train(x: np.ndarray, start: tuple, y: np.ndarray, weight: np.ndarray, done: int, passes: int, seed: int, rate: float = 1.0, decay: float = 0.05, at_once: int = 2048) -> tuple[np.ndarray, float, np.ndarray, float]:
    """Carries a logistic model on rows of numbered properties further by adaptive steps, after the passes done. Number 0 stands for no property and has no weight.

    The model is weights and bias, and for both the sum of squared gradients that the steps are divided by.
    """
    rng = np.random.default_rng(seed)
    w, b, g2, b2 = start[0].copy(), start[1], start[2].copy(), start[3]
    for turn in range(done + passes):
        order = rng.permutation(len(x))
        if turn < done:
            continue
        for at in range(0, len(order), at_once):
            rows = order[at : at + at_once]
            own = x[rows]
            p = 1 / (1 + np.exp(-np.clip(w.take(own).sum(1) + b, -30, 30)))
            e = weight[rows] * (p - y[rows])
            g = np.bincount(own.ravel(), np.repeat(e, x.shape[1]), len(w))
            g[0] = 0.0
            met = np.flatnonzero(g != 0)
            g = g[met] + decay * w[met]
            g2[met] += g * g
            w[met] -= rate * g / np.sqrt(g2[met])
            s = float(e.sum())
            b2 += s * s
            b -= rate * s / math.sqrt(b2)
    return w, b, g2, b2


def _calibrated(z: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Scale and shift that make logits of texts the model hasn't seen into log odds."""
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
        g, h = weight * (p - y), weight * p * (1 - p)
        m = np.array([[(h * z * z).sum() + 1, (h * z).sum()], [(h * z).sum(), h.sum() + 1]])
        step = np.linalg.solve(m, [(g * z).sum(), g.sum()])
        a, b = a - step[0], b - step[1]
    return float(a), float(b)


@dataclass
class _State:
    """Where training stands, of each fold's model: the properties it knows, weights, bias, their sums of squared gradients, and what an artificial cut counts; and the models of the round before with the shares of cuts among real ends away from and at limits, which say what a real end counts."""

    known: list[np.ndarray]
    models: list[tuple]
    balance: list[float]
    before: tuple[np.ndarray, np.ndarray] | None = None
    priors: tuple[float, float] = (0.0, 0.0)

    def whole(self) -> tuple[np.ndarray, np.ndarray]:
        """Weights of all properties, and biases."""
        out = np.zeros((len(self.known), (1 << BITS) + 1))
        for k, known in enumerate(self.known):
            out[k][known] = self.models[k][0][1:]
        return out, np.array([m[1] for m in self.models])


@dataclass
class _Part:
    """Examples of a part's texts: properties, filled up with 1 << BITS, and of each whether it is an artificial cut, its fold, and whether it lies at a limit."""

    number: int
    x: np.ndarray
    cut: np.ndarray
    fold: np.ndarray
    at_limit: np.ndarray

    def logits(self, models: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        """Of each example by the model that hasn't seen its fold."""
        z = np.zeros(len(self.x))
        for k, (w, b) in enumerate(zip(*models)):
            own = self.fold == k
            z[own] = w[self.x[own]].sum(1) + b
        return z

    def weight(self, state: _State) -> np.ndarray:
        """What each real end counts. Some are cut, most of them at limits: these count less at first, and after each round a real end counts by its chance of being whole, as the model that hasn't seen it has it."""
        real = self.cut == 0
        if state.before is None:
            return np.where(real & self.at_limit, 0.25, 1.0)
        out, z = np.ones(len(self.x)), self.logits(state.before)
        for own, prior in ((real & ~self.at_limit, state.priors[0]), (real & self.at_limit, state.priors[1])):
            out[own] = 1 - _chance(z[own], prior)
        return out


def _chance(z: np.ndarray, prior: float) -> np.ndarray:
    """The chance of being cut of a real end of this logit, where the share of cuts among real ends is prior."""
    return 1 / (1 + np.exp(np.clip(-z, -30, 30)) * (1 - prior) / prior)


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[_Part]:
    for batch in batches:
        for number, n, width, x, kind in zip(*(batch.column(c) for c in ("part", "n", "width", "x", "kind"))):
            n, width = n.as_py(), width.as_py()
            planes = np.frombuffer(pa.Codec("zstd").decompress(x.as_buffer(), n * width * 3), np.uint8).reshape(3, width, n)
            whole = np.zeros((n, width), np.int32)
            for i, plane in enumerate(planes):
                whole |= plane.T.astype(np.int32) << (8 * i)
            kind = np.frombuffer(kind.as_py(), np.uint8)
            yield _Part(number.as_py(), whole, kind & 1, kind >> 2, (kind & 2) > 0)


def _vectors(found: dict[int, np.ndarray], part: int) -> Iterator[pa.RecordBatch]:
    """Vectors by number as rows of blocks, to be added up by _summed."""
    for key, v in found.items():
        blocks = range(0, len(v), BLOCK)
        values = [v[i : i + BLOCK].astype(np.float32).tobytes() for i in blocks]
        yield pa.RecordBatch.from_arrays(
            [pa.array([key] * len(values), pa.int32()), pa.array([i // BLOCK for i in blocks], pa.int32()), pa.array([part] * len(values), pa.int32()), pa.array(values, pa.binary())],
            names=["key", "block", "part", "v"],
        )


def _add_blocks(rows: pa.Table) -> pa.Table:
    rows = rows.sort_by("part")
    total = np.sum([np.frombuffer(v, np.float32) for v in rows.column("v").to_pylist()], axis=0, dtype=np.float64)
    return pa.table({"key": rows.column("key")[:1], "block": rows.column("block")[:1], "v": pa.array([total.tobytes()], pa.binary())})


def _summed(packed: DataFrame, f) -> dict[int, np.ndarray]:
    """The sums of the vectors that f makes of the parts. They are added up within each task, then by blocks on the executors, so the driver gets one of each, however many parts there are."""
    rows = arrow_map(packed, f, "key int, block int, part int, v binary").groupBy("key", "block").applyInArrow(_add_blocks, "key int, block int, v binary").collect()
    out: dict[int, list] = {}
    for r in sorted(rows, key=lambda r: (r.key, r.block)):
        out.setdefault(r.key, []).append(np.frombuffer(r.v, np.float64))
    return {key: np.concatenate(blocks) for key, blocks in out.items()}


def _add_up(f):
    """A function of batches that adds up the vectors that f makes of each part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        first = None
        for part in _parts(batches):
            first = part.number if first is None else first
            for key, v in f(part):
                total[key] = total[key] + v if key in total else v
        if first is not None:
            yield from _vectors(total, first)

    return run


def _support(folds: int):
    """Of each fold how many examples have each property."""
    return _add_up(lambda part: ((k, np.bincount(part.x[part.fold == k].ravel(), minlength=(1 << BITS) + 1)[:-1]) for k in range(folds)))


def _legs(shared, done: int, passes: int):
    """Carries the models further on each part. Of each fold, under 2k and 2k + 1: how far each weight moved times the sum of its squared gradients, and these sums; the bias is the last."""

    def of_part(part: _Part) -> Iterator[tuple[int, np.ndarray]]:
        state: _State = shared.value
        weight, real, folds = part.weight(state), part.cut == 0, len(state.known)
        for k, known in enumerate(state.known):
            weight[~real] = state.balance[k]
            seen = (part.fold != k) if folds > 1 else np.ones(len(part.x), bool)
            number = np.zeros((1 << BITS) + 1, np.int64)
            number[known] = np.arange(1, len(known) + 1)
            start = state.models[k]
            w, b, g2, b2 = _train(number[part.x[seen]], start, part.cut[seen].astype(float), weight[seen], done, passes, seed=k)
            squares = np.append(g2[1:] - start[2][1:], b2 - start[3])
            yield 2 * k, np.append(w[1:] - start[0][1:], b - start[1]) * squares
            yield 2 * k + 1, squares

    return _add_up(of_part)


def _mixed(start: tuple, moved: np.ndarray, squares: np.ndarray, parts: int) -> tuple:
    """A model carried further by all parts: each weight moves by the parts' mean move, in which a part counts by its squared gradients, so parts that haven't met a property don't hold it back."""
    step = np.divide(moved, squares, out=np.zeros(len(moved)), where=squares > 0)
    w, g2 = start[0].copy(), start[2].copy()
    w[1:] += step[:-1]
    g2[1:] += squares[:-1] / parts
    return w, start[1] + step[-1], g2, start[3] + squares[-1] / parts


def _logit_counts(shared):
    """Of each fold, kind (0 and 1 real ends away from and at limits, 2 cuts) and step of logits: how many examples, and what they count together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: _State = shared.value
        models = state.whole()
        for part in _parts(batches):
            step = np.rint(np.clip(part.logits(models), -30, 30) * STEPS).astype(np.int64) + 30 * STEPS
            key = (part.fold.astype(np.int64) * 3 + np.where(part.cut > 0, 2, part.at_limit)) * (60 * STEPS + 1) + step
            found, at, n = np.unique(key, return_inverse=True, return_counts=True)
            weight = np.bincount(at, part.weight(state), len(found))
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array(n, pa.int64()), pa.array(weight, pa.float64())], names=["key", "n", "weight"])

    return run


@dataclass
class _Counts:
    """Counts of examples by fold, kind and logit."""

    fold: np.ndarray
    kind: np.ndarray
    z: np.ndarray
    n: np.ndarray
    weight: np.ndarray

    @classmethod
    def of(cls, packed: DataFrame, shared) -> _Counts:
        rows = arrow_map(packed, _logit_counts(shared), "key long, n long, weight double").groupBy("key").agg(F.sum("n").alias("n"), F.sum("weight").alias("weight")).toArrow()
        key, n, weight = (rows.column(c).to_numpy() for c in ("key", "n", "weight"))
        order = np.argsort(key)
        key = key[order]
        size = 60 * STEPS + 1
        return cls(key // size // 3, key // size % 3, (key % size) / STEPS - 30, n[order], weight[order])


def _share_of_cuts(z: np.ndarray, n: np.ndarray, prior: float, most: float) -> float:
    """The share of cuts among real ends, from their logits."""
    used = prior
    for _ in range(30 if len(z) else 0):
        used = prior
        prior = float(np.clip(np.average(_chance(z, prior), weights=n), 0.005, most))
    return used


def _balance(fold: np.ndarray, real: np.ndarray, cuts: np.ndarray, folds: int) -> list[float]:
    """What a cut counts for each fold's model, so that cuts and real ends count alike; real: what these count, cuts: their number, both by fold."""
    seen = [(fold != k) if folds > 1 else np.ones(len(fold), bool) for k in range(folds)]
    return [float(real[s].sum() / max(1, cuts[s].sum())) for s in seen]


def fit_weights(packed: DataFrame, folds: int = FOLDS) -> EndModel | None:
    """A logistic model a fold, the logit from which on an ending is plainly cut, and the share of cuts that look complete, by the examples of all parts (example_parts). None without examples.

    The models are carried further by each part on its own, and their moves mixed, so that all texts shape the same models while a task holds one part. Which
    properties are known, what ends count, calibration and thresholds come from sums and counts over all examples. The numbers below are where the estimates start and how far they may go.
    """
    spark = packed.sparkSession
    kinds = np.array([r.kinds for r in packed.select("kinds").collect()], np.int64).reshape(-1, folds, 3)
    parts, kinds = len(kinds), kinds.sum(0)
    if not parts:
        return None
    found = _summed(packed, _support(folds))
    support = np.array([found[k] for k in range(folds)])
    known = [np.flatnonzero((support.sum(0) - support[k] if folds > 1 else support[k]) >= SUPPORT) for k in range(folds)]
    each = np.arange(folds)
    state = _State(known, [], _balance(each, kinds[:, 0] + 0.25 * kinds[:, 1], kinds[:, 2], folds))
    for turn in range(ROUNDS):
        state.models = [(np.zeros(len(own) + 1), 0.0, np.ones(len(own) + 1), 1.0) for own in known]
        ends = [PASSES * (i + 1) // MIXES for i in range(MIXES)]
        for done, until in zip([0, *ends], ends):
            shared = spark.sparkContext.broadcast(state)
            moves = _summed(packed, _legs(shared, done, until - done))
            shared.destroy()
            state.models = [_mixed(m, moves[2 * k], moves[2 * k + 1], parts) for k, m in enumerate(state.models)]
        shared = spark.sparkContext.broadcast(state)
        counts = _Counts.of(packed, shared)
        shared.destroy()
        if turn < ROUNDS - 1:
            away, at = counts.kind == 0, counts.kind == 1
            state.before = state.whole()
            state.priors = (_share_of_cuts(counts.z[away], counts.n[away], 0.08, 0.5), _share_of_cuts(counts.z[at], counts.n[at], 0.75, 0.95))
            real = np.zeros(folds)
            for own, prior in zip((away, at), state.priors):
                real += np.bincount(counts.fold[own], counts.n[own] * (1 - _chance(counts.z[own], prior)), folds)
            state.balance = _balance(each, real, kinds[:, 2], folds)
    cut = counts.kind == 2
    weight = np.where(cut, counts.n * (counts.weight[~cut].sum() / max(1, counts.n[cut].sum())), counts.weight)
    a, b = _calibrated(counts.z, cut.astype(float), weight)
    if not (np.isfinite(a) and a > 0):
        a, b = 1.0, 0.0
    z, away = a * counts.z + b, counts.kind == 0
    w, bias = state.whole()
    real, n_real = z[away], counts.n[away]
    return EndModel((w * a).astype(np.float32), bias * a + b, plain_logit(real, n=n_real), complete_share(real, z[cut], n_real, counts.n[cut]))


def plain_logit(real: np.ndarray, false_share: float = FALSE_SHARE, n: np.ndarray | None = None) -> float:
    """The logit from which on an ending away from limits is taken for cut by itself, with at most the given share of whole ends among those beyond it.

    Whole ends get fewer towards the cut ones by about the same factor a unit; it's taken from the two units below 0, where cut and whole are
    equally likely by the ending, and carried on beyond, where they can't be counted. 0 if there are too few ends to tell. n: how many ends have each logit, one unless given.
    """
    n = np.ones(len(real), np.int64) if n is None else n
    far, near = int(n[(real >= -2) & (real < -1)].sum()), int(n[(real >= -1) & (real < 0)].sum())
    if far < 20:
        return 0.0
    rate = max(0.5, math.log((far + 1) / (near + 1)))
    for t in np.arange(0, 6, 0.05):
        if near / math.expm1(rate) * math.exp(-rate * t) <= false_share * max(1, int(n[real > t].sum())):
            return float(t)
    return 6.0


def complete_share(real: np.ndarray, cuts: np.ndarray, n_real: np.ndarray | None = None, n_cuts: np.ndarray | None = None) -> float:
    """The share of cuts at even places that fall where a text looks complete: how many of them end as the plainest of the real ends do. n_real, n_cuts: how many have each logit, one unless given."""
    n_real = np.ones(len(real), np.int64) if n_real is None else n_real
    n_cuts = np.ones(len(cuts), np.int64) if n_cuts is None else n_cuts
    if n_real.sum() < 100 or n_cuts.sum() < 100:
        return 0.0
    at = np.quantile(real, (0.25, 0.4, 0.55, 0.7), weights=n_real, method="inverted_cdf")
    return float(min(np.average(cuts < t, weights=n_cuts) / np.average(real < t, weights=n_real) for t in at + 1e-9))


def _word_counts(texts: list[str]) -> dict[str, int]:
    counts: dict[str, int] = {}
    for text in texts:
        found = _WORD.findall(text)
        for w in found[:-1]:
            counts[w] = counts.get(w, 0) + 1
    return counts


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts = _word_counts([t for t in batch.column("text").to_pylist() if t])
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])


def vocabulary(texts: DataFrame) -> DataFrame:
    """last, whole and longer: of each word of the texts and each beginning of one (up to 23 characters), how often it stands alone, and how often as a longer word's beginning.

    All words of all texts count; a text's last run of letters doesn't, as it may be cut. Counts are combined before each shuffle and stay with the executors.
    """
    counts = settled(arrow_map(texts.select("text"), _count_words, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")))
    begun = counts.where(F.length("word") > 1).select("word", "n", F.explode(F.sequence(F.lit(1), F.least(F.length("word"), F.lit(24)) - 1)).alias("k"))
    none = F.lit(0).cast("long")
    both = counts.select(F.col("word").alias("last"), F.col("n").alias("whole"), none.alias("longer"))
    both = both.unionAll(begun.select(F.left("word", F.col("k")).alias("last"), none.alias("whole"), F.col("n").alias("longer")))
    return settled(both.groupBy("last").agg(F.sum("whole").alias("whole"), F.sum("longer").alias("longer")))


def _with_counts(rows: DataFrame, words: DataFrame) -> DataFrame:
    """Adds whole and longer of each row's last word, 0 for an unknown one. Rows without a last word, most of them, have no part in the join."""
    met = small_join(rows.where(F.col("last").isNotNull()), words, ["last"], "left")
    rest = rows.where(F.col("last").isNull()).withColumns({c: F.lit(0).cast("long") for c in ("whole", "longer")})
    return met.unionByName(rest).withColumns({c: F.coalesce(c, F.lit(0)) for c in ("whole", "longer")})


def _pieces(text: str, cuts: int) -> Iterator[tuple[str, int]]:
    """A text without the mark of a cut, and artificial cuts of it; whether it is one of these."""
    whole, _ = unmarked(text)
    if not whole.strip():
        return
    yield whole, 0
    rng = np.random.default_rng(zlib.crc32(text.encode("utf-8", "surrogatepass")))
    for _ in range(cuts):
        piece = cut_at_random(whole, rng)
        if piece.strip():
            yield piece, 1


def _last_words(cuts: int):
    """The last words of the examples of each part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = {(part, _last_word(piece.rstrip())) for part, text in zip(batch.column("part").to_pylist(), batch.column("text").to_pylist()) for piece, _ in _pieces(text, cuts)}
            rows = [r for r in found if r[1] is not None]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.string())], names=["part", "last"])

    return run


def _packed(part: int, found: list[np.ndarray], kinds: list[int], folds: int) -> pa.RecordBatch:
    """The examples of a part as one row: properties by place and byte, compressed, and of each example cut + 2 at_limit + 4 fold."""
    size = np.array([len(f) for f in found])
    x = np.full((len(size), int(size.max())), 1 << BITS, np.int32)
    x[np.arange(x.shape[1]) < size[:, None]] = np.concatenate(found)
    kind = np.array(kinds, np.uint8)
    # rows come in no fixed order
    mixed = (x.astype(np.uint64) * np.random.default_rng(0).integers(1, 2**63, x.shape[1], np.uint64)).sum(1)
    order = np.lexsort((mixed, kind & 2, kind & 1, kind >> 2))
    x, kind = x[order], kind[order]
    planes = b"".join(((x >> (8 * i)) & 255).astype(np.uint8).T.tobytes() for i in range(3))
    counts = np.bincount((kind >> 2) * 3 + np.where(kind & 1, 2, (kind & 2) >> 1), minlength=3 * folds)
    arrays = [pa.array([v], t) for v, t in ((part, pa.int32()), (len(x), pa.int32()), (x.shape[1], pa.int32()), (pa.Codec("zstd").compress(planes, asbytes=True), pa.binary()), (kind.tobytes(), pa.binary()), (counts.tolist(), pa.list_(pa.int64())))]
    return pa.RecordBatch.from_arrays(arrays, names=["part", "n", "width", "x", "kind", "kinds"])


def _examples(cuts: int, folds: int):
    """Packs the examples of each part, whose rows come together: first the counts of words (last, whole, longer), then the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, words, found, kinds = None, {}, [], []
        for batch in batches:
            for part, last, whole, longer, text, at_limit in zip(*(batch.column(c).to_pylist() for c in ("part", "last", "whole", "longer", "text", "at_limit"))):
                if part != own:
                    if found:
                        yield _packed(own, found, kinds, folds)
                    own, words, found, kinds = part, {}, [], []
                if text is None:
                    words[last] = (whole, longer)
                    continue
                k = None
                for piece, cut in _pieces(text, cuts):
                    k = fold_of(piece, folds) if k is None else k
                    found.append(np.array(features(piece, words), np.int32))
                    kinds.append(cut + 2 * at_limit + 4 * k)
        if found:
            yield _packed(own, found, kinds, folds)

    return run


def example_parts(texts: DataFrame, words: DataFrame, part: int = PART, cuts: int = CUTS, folds: int = FOLDS) -> DataFrame:
    """The examples made of all distinct texts (text, at_limit), dealt by a hash of the text into parts of so many texts: each real end, and artificial cuts of the same text at even places. A row a part, settled.

    Only hashed properties are written, some 35 numbers an example. A task holds the properties of one part, and the counts (words: vocabulary) of those words that its examples end with.
    """
    parts = max(1, math.ceil(texts.count() / part))
    dealt = texts.select(F.pmod(F.xxhash64("text"), F.lit(parts)).cast("int").alias("part"), "text", "at_limit")
    lasts = settled(arrow_map(dealt, _last_words(cuts), "part int, last string").distinct())
    lasts = small_join(lasts, words, ["last"], "inner")
    rows = lasts.select("part", "last", "whole", "longer").unionByName(dealt, allowMissingColumns=True)
    rows = rows.repartitionById(parts, F.col("part")).sortWithinPartitions("part", F.col("text").isNotNull())
    return settled(arrow_map(rows, _examples(cuts, folds), "part int, n int, width int, x binary, kind binary, kinds array<long>"))


def fit_end_model(texts: DataFrame, words: DataFrame, part: int = PART, cuts: int = CUTS, folds: int = FOLDS) -> EndModel:
    """Learns from all distinct texts (text, at_limit) how texts end: each real end against artificial cuts of the same text at even places.

    Nothing is labelled by hand and no text is left out: more texts make more parts, which are trained on side by side. The driver gets models and counts of logits, whose size is fixed.
    """
    found = fit_weights(example_parts(texts, words, part, cuts, folds), folds)
    return found or EndModel(np.zeros((1, (1 << BITS) + 1), np.float32), np.zeros(1))


def limits(rows: DataFrame, near: int = NEAR, false_share: float = FALSE_SHARE, least: int = LEAST_TEXTS) -> DataFrame:
    """source, unit (chars or bytes) and length of the field limits, with `excess`, the share of the texts there that chance doesn't explain.

    rows: source, unit, length, h (a hash of the text). The hazard of a length is the share of a source's distinct texts that end there, of those that reach
    it; a window over the source's lengths gives it for each length and for the lengths around it. Under the null a length's count is Poisson with
    the neighbours' hazard; its tail is bounded by Chernoff, and limits are the lengths that pass the Benjamini-Hochberg
    step at the share of false ones given. Copies count once, so a text with many copies makes no limit.
    """
    lengths = rows.groupBy("source", "unit", "length", "h").agg(F.lit(1).alias("one")).groupBy("source", "unit", "length").agg(F.count(F.lit(1)).alias("n"))
    by = Window.partitionBy("source", "unit").orderBy("length")
    around = by.rangeBetween(-near, near)
    hazards = (
        lengths.withColumn("at_risk", F.sum("n").over(by.rangeBetween(0, Window.unboundedFollowing)))
        .withColumn("ended", F.sum("n").over(around) - F.col("n"))
        .withColumn("exposed", F.col("at_risk") * (2 * near) + F.col("ended") / 2 * near)
    )
    # a length nobody ends at nearby still has a hazard: half a text over the exposure
    expected = F.col("at_risk") * (F.col("ended") + 0.5) / F.col("exposed")
    n = F.col("n")
    # minus the logarithm of the bound, in steps of 1/64: its exponential is at most 1.6 % too high
    surprise = F.when(n > F.col("expected"), n * F.log(n / F.col("expected")) - n + F.col("expected")).otherwise(F.lit(0.0))
    tested = hazards.withColumn("expected", expected).withColumn("step", F.floor(F.least(surprise, F.lit(700.0)) * 64).cast("int"))
    tested = settled(tested.select("source", "unit", "length", "n", "expected", "step"))
    tests = max(1, tested.count())
    # the step needs how many lengths are at least as surprising as each step, of which there are 44,801 at most, whatever there is to test
    steps = tested.where(n >= least).groupBy("step").agg(F.count(F.lit(1)).alias("k"))
    upto = steps.withColumn("k", F.sum("k").over(Window.orderBy(F.desc("step"))))
    passed = upto.where(F.exp(-F.col("step") / 64) <= F.col("k") * false_share / tests).agg(F.min("step").alias("step"))
    found = tested.where((n >= least) & (F.col("step") >= F.coalesce(passed.scalar(), F.lit(2**31 - 1))))
    return found.select("source", "unit", "length", "n", (1 - F.col("expected") / n).alias("excess"))


def _scores(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: EndModel = model.value
        for batch in batches:
            rows = []
            for text in batch.column("text").to_pylist():
                whole, marked = unmarked(text)
                rows.append((marked, *(m.of_ending(whole) if whole.strip() else (0, 0.0, None))))
            kinds = {"marked": pa.bool_(), "fold": pa.int32(), "logit": pa.float64(), "last": pa.string()}
            own = ["doc_id", "source", "excess"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in own), *(pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds.values()))], names=[*own, *kinds])

    return run


def _score_words(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: EndModel = model.value
        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("logit", "fold", "last", "whole", "longer"))
            logits = [z if last is None else z + m.of_word(k, last, whole, longer) for z, k, last, whole, longer in zip(*columns)]
            own = ["doc_id", "source", "excess", "marked"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in own), pa.array(logits, pa.float64())], names=[*own, "logit"])

    return run


def score_endings(documents: DataFrame, sample: int = PART) -> DataFrame:
    """doc_id, source, at_limit, marked, logit and chance (of being cut) of every document with a text that isn't blank.

    A text is at a limit if its length in characters or bytes is one of its source's limits; where the last character has several bytes, a limit in
    bytes also holds up to a character around it, as a cut can't always fall on it.

    chance: at a limit the odds of its excess times those of the ending; and times how much more often texts at limits end with the mark of a cut than others
    do, if the text has one. Elsewhere the odds of the ending against those from which on it is plainly cut (plain_logit). A cut that happens to leave a complete
    text is none: the chance is lessened by the share of such among cuts of this logit (complete_share).

    sample: how many texts are trained on as one part; all parts are, whatever it is.
    """
    texts = take(documents, "doc_id", "text", "source").where(F.btrim(F.coalesce("text", F.lit("")), F.lit(WHITE_SPACE)) != "")
    texts = texts.withColumns({"source": F.coalesce("source", F.lit("")), "chars": F.length("text").cast("long"), "bytes": F.octet_length("text").cast("long")})
    measured = texts.select("source", F.xxhash64("text").alias("h"), F.explode(F.array(*(F.struct(F.lit(u).alias("unit"), F.col(u).alias("length")) for u in ("chars", "bytes")))).alias("m"))
    found = settled(limits(measured.select("source", "m.unit", "m.length", "h")))
    chars = found.where(F.col("unit") == "chars").select("source", F.col("length").alias("chars"), F.col("excess").alias("by_chars"))
    around = found.where(F.col("unit") == "bytes").select("source", "length", "excess", F.explode(F.sequence(F.col("length") - 3, F.col("length") + 2)).alias("bytes"))
    around = around.groupBy("source", "bytes").agg(F.max(F.when(F.col("bytes") == F.col("length"), F.col("excess"))).alias("by_bytes"), F.max("excess").alias("near_bytes"))
    texts = small_join(small_join(texts, chars, ["source", "chars"], "left"), around, ["source", "bytes"], "left")
    near = F.when(F.octet_length(F.right("text", F.lit(1))) > 1, F.col("near_bytes"))
    texts = texts.withColumn("excess", F.greatest("by_chars", "by_bytes", near)).select("doc_id", "source", "text", "excess")
    distinct = settled(texts.groupBy("text").agg(F.bool_or(F.col("excess").isNotNull()).alias("at_limit")))
    words = vocabulary(distinct)
    model = fit_end_model(distinct, words, sample)
    shared = texts.sparkSession.sparkContext.broadcast(model)
    scored = settled(arrow_map(texts, _scores(shared), "doc_id long, source string, excess double, marked boolean, fold int, logit double, last string"))
    scored = settled(arrow_map(_with_counts(scored, words), _score_words(shared), "doc_id long, source string, excess double, marked boolean, logit double"))
    at_limit = F.col("excess").isNotNull()
    n = scored.agg(*(F.count_if(x) for x in (at_limit, at_limit & F.col("marked"), ~at_limit, ~at_limit & F.col("marked")))).first()
    mark = math.log(max(1.0, (n[1] + 0.5) / (n[0] + 1) * (n[2] + 1) / (n[3] + 0.5)))
    share = F.greatest(F.lit(1 - SURE), F.least(F.lit(SURE), F.col("excess")))
    weight = F.when(at_limit, F.log(share / (1 - share)) + F.when(F.col("marked"), mark).otherwise(0.0)).otherwise(-model.plain)
    cut = 1 / (1 + F.exp(-F.col("logit") - weight))
    open_ = F.when(F.col("marked"), 1.0).otherwise(F.greatest(F.lit(0.0), 1 - model.complete * F.exp(-F.col("logit"))))
    return scored.select("doc_id", "source", at_limit.alias("at_limit"), "marked", "logit", (cut * open_).alias("chance"))


def truncated(documents: DataFrame, sample: int = PART) -> DataFrame:
    """doc_id of the documents whose text stops before its end, at a limit of its source or in transfer.

    Two things must agree: how likely a cut is at this length of this source (limits), and how the text ends (a model fitted to tell real ends from
    artificial cuts). The larger the excess of a limit, the less odd an ending will do; elsewhere it must be incomplete by itself. A complete text that
    happens to fill its field isn't flagged. NULL, empty and white-space texts are no cases; a NULL source is a source of its own; copies
    of a text are judged alike. An empty table gives no rows.
    """
    return score_endings(documents, sample).where(F.col("chance") > 0.5).select("doc_id")


def truncated_with_limits(documents: DataFrame, sample: int = PART) -> DataFrame:
    """doc_id and at_limit of what truncated gives: true where the text ends at a significant length of its source, false where it's flagged for its ending alone, as cuts in transfer are."""
    return score_endings(documents, sample).where(F.col("chance") > 0.5).select("doc_id", "at_limit")


def truncation_by_source(documents: DataFrame, sample: int = PART) -> DataFrame:
    """Of each source: texts, how many are cut, how many of those at a limit, and the share."""
    cut = F.col("chance") > 0.5
    out = score_endings(documents, sample).groupBy("source").agg(
        F.count(F.lit(1)).alias("texts"), F.count_if(cut).alias("cut"), F.count_if(cut & F.col("at_limit")).alias("cut_at_limit")
    )
    return out.withColumn("share", F.col("cut") / F.col("texts"))
