"""Toxicity by a bidirectional gated recurrent network with attention pooling (operator 12).

Inputs. A word comes as itself (an embedding and the log-odds of toxic documents that hold
it) and as characters (embeddings and log-odds of its n-grams, ends marked), so that unseen
forms of a known stem are told. Log-odds are shrunk towards nothing for what few documents
hold, and a training document is left out of its own.

Network. Two gated recurrent passes over a window of `WINDOW` words, forwards and backwards;
attention weighs their states; a linear layer gives the window's logit. Windows overlap by
half and the last one ends with the text, so every word is scored; a text scores as its most
toxic window. Weights are trained in numpy with Adam: a toxic document teaches by the window
that the network finds most toxic in it, a clean one by its worst windows and one by chance.

The classifier is fitted on the driver from at most `MAX_TOXIC` and `MAX_CLEAN` labelled
documents, chosen by a hash of their ids, none of over `MAX_CHARS` characters. Everything
else is one pass over the texts; the inputs of a distinct word are made once per worker.

Defined results: null and empty texts, and texts without words, score 0; without labels of both classes every text scores the share of toxic ones, 0
without any; a document with several labels is toxic if one says so; a null doc_id is not held
out; repeated rows keep a row each; other columns are not carried.
"""

from __future__ import annotations

import math
import string
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows, as_longs, as_texts
from .language_id import held_out

WINDOW, STEP = 16, 8
HIDDEN, EMBEDDED = 8, 8
GRAMS = (3, 4, 5)
MAX_TOXIC, MAX_CLEAN, MAX_CHARS = 1_000, 3_000, 1_000_000
EPOCHS, RATE, BATCH = 10, 0.01, 256
#: Epochs before which the network ranks a document's windows anew.
RANKED = (3, 6)
SHRINK = 4.0
#: Least documents and log-odds of a word or n-gram that the model keeps.
LEAST_DOCS, LEAST_ODDS = 2, 1.0
CACHE = 1 << 19
WINDOWS_AT_ONCE = 1 << 12
EDGES = string.punctuation + "¡¿«»“”„‘’…–—"
SEED = 42


def words_of(text: str | None) -> list[str]:
    return [w.strip(EDGES) for w in (text or "").lower().split()]


def grams_of(word: str) -> set[str]:
    marked = f"^{word}$"
    return {marked[i : i + n] for n in GRAMS for i in range(len(marked) - n + 1)}


class Vocabulary:
    """Words and n-grams with the numbers of toxic and clean documents that hold them."""

    def __init__(self, texts: list[list[str]], toxic: np.ndarray):
        n = [max(1, int(toxic.sum())), max(1, int((~toxic).sum()))]
        self.share = n[0] / (n[0] + n[1])
        number: dict[str, int] = {}
        parts: dict[str, np.ndarray] = {}
        words, grams = (Counter(), Counter()), ([], [])
        for mine, bad in zip(texts, toxic, strict=True):
            distinct = set(mine)
            words[not bad].update(distinct)
            for w in distinct - parts.keys():
                parts[w] = np.array([number.setdefault(g, len(number)) for g in grams_of(w)], dtype=np.int64)
            if distinct:
                grams[not bad].append(np.unique(np.concatenate([parts[w] for w in distinct])))
        counted = [np.bincount(np.concatenate([np.zeros(0, np.int64), *g]), minlength=len(number)).tolist() for g in grams]
        self.words = self._kept((w, words[0][w], words[1][w]) for w in words[0].keys() | words[1].keys())
        self.grams = self._kept((g, counted[0][k], counted[1][k]) for g, k in number.items())

    def _kept(self, found: Iterable[tuple[str, int, int]]) -> dict[str, tuple[int, int, int, float]]:
        """number, toxic and clean documents, log-odds of those that tell; number 0 is for all others."""
        told = sorted((x, a, b) for x, a, b in found if a + b >= LEAST_DOCS and abs(self.odds(a, b)) >= LEAST_ODDS)
        return {x: (k + 1, a, b, self.odds(a, b)) for k, (x, a, b) in enumerate(told)}

    def odds(self, toxic: int, clean: int) -> float:
        p = (toxic + SHRINK * self.share) / (toxic + clean + SHRINK)
        return math.log(p / (1 - p)) - math.log(self.share / (1 - self.share)) if 0 < p < 1 else 0.0

    def inputs(self, word: str, own: int) -> tuple[list[float], int, list[int]]:
        """Log-odds inputs, number of the word, numbers of its n-grams, one toxic (own 1) or
        clean (own 0) document that holds the word left out."""
        whole, parts = self.words.get(word), [g for g in map(self.grams.get, grams_of(word)) if g]
        odds = lambda x: self.odds(max(0, x[1] - own), max(0, x[2] - 1 + own))
        return inputs_of([odds(g) for g in parts], odds(whole) if whole else 0.0), whole[0] if whole else 0, [g[0] for g in parts]


def inputs_of(told: list[float], seen: float) -> list[float]:
    """The log-odds of a word, the most of its n-grams, and a quarter of their sum."""
    return [seen, max(told, default=0.0), max(-4.0, min(4.0, sum(told) / 4))]


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 + 0.5 * np.tanh(0.5 * x)


class Network:
    """Weights, and the passes over windows of inputs. p: arrays by name."""

    def __init__(self, n_words: int, n_grams: int, seed: int = SEED):
        rng = np.random.default_rng(seed)
        draw = lambda *shape: (rng.standard_normal(shape) * 0.2).astype(np.float32)
        size = 3 + 2 * EMBEDDED
        self.p = {"word": draw(n_words, EMBEDDED), "gram": draw(n_grams, EMBEDDED), "attend": draw(2 * HIDDEN, HIDDEN), "query": draw(HIDDEN),
                  "out": draw(2 * HIDDEN), "bias": np.zeros(1, np.float32)}
        for side in "fb":
            self.p |= {f"x{side}": draw(size, 3 * HIDDEN), f"h{side}": draw(HIDDEN, 3 * HIDDEN), f"c{side}": np.zeros(3 * HIDDEN, np.float32)}
        self.p["word"][0] = self.p["gram"][0] = 0

    def states(self, gates: np.ndarray, side: str, mask: np.ndarray, keep: list | None = None) -> np.ndarray:
        """[n, WINDOW, HIDDEN] states from the inputs' share of the gates [n, WINDOW, 3 * HIDDEN]."""
        n, h, weight = len(gates), HIDDEN, self.p[f"h{side}"]
        state, out, whole = np.zeros((n, h), np.float32), np.zeros((n, WINDOW, h), np.float32), mask.all()
        for t in range(WINDOW) if side == "f" else range(WINDOW - 1, -1, -1):
            x = gates[:, t]
            rz = sigmoid(x[:, : 2 * h] + state @ weight[:, : 2 * h])
            r, z = rz[:, :h], rz[:, h:]
            carried = state @ weight[:, 2 * h :]
            new = np.tanh(x[:, 2 * h :] + r * carried)
            live, after = mask[:, t, None], (1 - z) * new + z * state
            if not whole:
                after = np.where(live, after, state)
            if keep is not None:
                keep.append((t, state, r, z, carried, new, live))
            state = out[:, t] = after
        return out

    def pool(self, states: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, ...]:
        p = self.p
        told = np.tanh(states @ p["attend"])
        weight = np.where(mask, told @ p["query"], -1e4)
        weight = np.exp(weight - weight.max(axis=1, keepdims=True))
        weight /= weight.sum(axis=1, keepdims=True)
        pooled = np.einsum("ntk,nt->nk", states, weight)
        return pooled @ p["out"] + p["bias"][0], told, weight, pooled

    def logits(self, gates: np.ndarray, mask: np.ndarray) -> np.ndarray:
        """gates: [n, WINDOW, 6 * HIDDEN], forwards before backwards."""
        h = 3 * HIDDEN
        return self.pool(np.concatenate((self.states(gates[..., :h], "f", mask), self.states(gates[..., h:], "b", mask)), axis=2), mask)[0]

    def gates(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate((x @ self.p["xf"] + self.p["cf"], x @ self.p["xb"] + self.p["cb"]), axis=-1)

    def gradients(self, x: np.ndarray, mask: np.ndarray, label: np.ndarray, weight: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
        """Of the weighted cross-entropy of windows x [n, WINDOW, inputs]; also that of x."""
        p, h = self.p, HIDDEN
        kept: dict[str, list] = {"f": [], "b": []}
        gates = self.gates(x)
        states = np.concatenate([self.states(gates[..., k * 3 * h : (k + 1) * 3 * h], s, mask, kept[s]) for k, s in enumerate("fb")], axis=2)
        logit, told, share, pooled = self.pool(states, mask)
        d = ((sigmoid(logit) - label) * weight / weight.sum()).astype(np.float32)
        g = {"out": pooled.T @ d, "bias": np.array([d.sum()], np.float32)}
        d_pooled = d[:, None] * p["out"]
        d_share = np.einsum("ntk,nk->nt", states, d_pooled)
        d_score = share * (d_share - (d_share * share).sum(axis=1, keepdims=True))
        d_told = d_score[..., None] * p["query"] * (1 - told**2)
        g["query"] = np.einsum("ntk,nt->k", told, d_score)
        g["attend"] = np.einsum("nti,ntj->ij", states, d_told)
        d_states = share[..., None] * d_pooled[:, None] + d_told @ p["attend"].T
        d_x = np.zeros_like(x)
        for k, s in enumerate("fb"):
            d_gates, d_state, weight_h = np.zeros((len(x), WINDOW, 3 * h), np.float32), np.zeros((len(x), h), np.float32), p[f"h{s}"]
            g[f"h{s}"] = np.zeros_like(weight_h)
            for t, before, r, z, carried, new, live in reversed(kept[s]):
                d_after = d_state + d_states[:, t, k * h : (k + 1) * h]
                d_live = np.where(live, d_after, 0)
                d_new = d_live * (1 - z) * (1 - new**2)
                d_z = d_live * (before - new) * z * (1 - z)
                d_r = d_new * carried * r * (1 - r)
                d_gates[:, t] = np.concatenate((d_r, d_z, d_new), axis=1)
                through = np.concatenate((d_r, d_z, d_new * r), axis=1)
                g[f"h{s}"] += before.T @ through
                d_state = np.where(live, d_live * z, d_after) + through @ weight_h.T
            g[f"x{s}"], g[f"c{s}"] = np.einsum("nti,ntj->ij", x, d_gates), d_gates.sum(axis=(0, 1))
            d_x += d_gates @ p[f"x{s}"].T
        return g, d_x


class Words:
    """Rows of inputs of distinct words; row 0 is padding. own: as in `Vocabulary.inputs`, none where texts are scored."""

    def __init__(self, vocabulary: Vocabulary, own: int | None = None):
        self.vocabulary, self.own, self.rows = vocabulary, own, {}
        self.odds, self.word, self.grams = [[0.0] * 3], [0], [[]]

    def numbers(self, words: list[str]) -> np.ndarray:
        rows = self.rows
        for w in words:
            if w not in rows:
                odds, word, grams = self.vocabulary.inputs(w, self.own)
                rows[w] = len(self.odds)
                self.odds.append(odds)
                self.word.append(word)
                self.grams.append(grams)
        return np.fromiter((rows[w] for w in words), dtype=np.int64, count=len(words))

    def add(self, whole: tuple[int, int, int, float] | None, grams: list[int], told: list[float]) -> None:
        """A row of a word as the vocabulary knows it, with all documents."""
        self.odds.append(inputs_of(told, whole[3] if whole else 0.0))
        self.word.append(whole[0] if whole else 0)
        self.grams.append(grams)

    def matrix(self, net: Network, start: int = 0) -> np.ndarray:
        """[rows from start on, inputs]."""
        grams = self.grams[start:]
        owner = np.repeat(np.arange(len(grams)), [len(g) for g in grams])
        chars = np.zeros((len(grams), EMBEDDED), np.float32)
        np.add.at(chars, owner, net.p["gram"][[i for g in grams for i in g]] if len(owner) else np.zeros((0, EMBEDDED), np.float32))
        return np.concatenate((np.array(self.odds[start:], np.float32).reshape(-1, 3), net.p["word"][self.word[start:]], chars), axis=1)


def windows(numbers: np.ndarray) -> np.ndarray:
    """[windows, WINDOW] rows of overlapping windows over a text; 0 pads a short one."""
    n = len(numbers)
    if n <= WINDOW:
        return np.pad(numbers, (0, WINDOW - n))[None]
    starts = np.append(np.arange(0, n - WINDOW, STEP), n - WINDOW)
    return numbers[starts[:, None] + np.arange(WINDOW)]


def train(rows: list[tuple[str, int]], epochs: int = EPOCHS, seed: int = SEED) -> tuple[Vocabulary, Network] | float:
    """Fit on (text, toxic); a share where a class is missing."""
    toxic = np.array([bool(y) for _, y in rows], dtype=bool)
    if not toxic.any() or toxic.all():
        return float(toxic.mean()) if len(rows) else 0.0
    texts = [words_of(t) for t, _ in rows]
    vocabulary = Vocabulary(texts, toxic)
    net = Network(1 + len(vocabulary.words), 1 + len(vocabulary.grams), seed)
    sides = [Words(vocabulary, own=0), Words(vocabulary, own=1)]
    # Rows of the toxic documents' words follow those of the clean ones'.
    numbers = [sides[y].numbers(t) for t, y in zip(texts, toxic.astype(int), strict=True)]
    shift = len(sides[0].odds)
    every = [windows(n + shift * y if y else n) for n, y in zip(numbers, toxic.astype(int), strict=True)]
    flat, owner = np.concatenate(every), np.repeat(np.arange(len(every)), [len(w) for w in every])
    pads = (0, shift)
    grams = sides[0].grams + sides[1].grams
    word = np.array(sides[0].word + sides[1].word)
    rng = np.random.default_rng(seed)
    mean, var = ({k: np.zeros_like(v) for k, v in net.p.items()} for _ in range(2))
    matrix = np.concatenate([s.matrix(net) for s in sides])
    first = np.concatenate(([0], np.cumsum([len(w) for w in every])[:-1]))
    rank = matrix[:, :2].max(axis=1)[flat].max(axis=1)
    steps = 0
    for epoch in range(epochs):
        if epoch in RANKED:
            gates = net.gates(matrix)
            rank = np.concatenate([net.logits(gates[w], ~np.isin(w, pads)) for w in np.array_split(flat, max(1, len(flat) // WINDOWS_AT_ONCE))])
        order = np.lexsort((-rank, owner))
        chance = first + rng.integers(0, [len(w) for w in every])
        second = order[np.minimum(first + 1, np.append(first[1:], len(flat)) - 1)]
        chosen = np.concatenate((order[first], second[~toxic], chance[~toxic]))
        label = toxic[owner[chosen]]
        for part in np.array_split(rng.permutation(len(chosen)), max(1, len(chosen) // BATCH)):
            w, y = flat[chosen[part]], label[part].astype(np.float32)
            used, place = np.unique(w, return_inverse=True)
            place = place.reshape(w.shape)
            x, mask = matrix[used][place], ~np.isin(w, pads)
            # Now and then a word goes by its characters alone, as an unseen one will.
            hidden = rng.random(w.shape) < 0.3
            x[hidden, 0], x[hidden, 3 : 3 + EMBEDDED] = 0, 0
            g, d_x = net.gradients(x, mask, y, np.ones(len(y), np.float32))
            d_x[hidden, 3 : 3 + EMBEDDED] = 0
            per_word = np.zeros((len(used), d_x.shape[2]), np.float32)
            np.add.at(per_word, place.ravel(), d_x.reshape(-1, d_x.shape[2]))
            g["word"], g["gram"] = np.zeros_like(net.p["word"]), np.zeros_like(net.p["gram"])
            np.add.at(g["word"], word[used], per_word[:, 3 : 3 + EMBEDDED])
            of = np.repeat(np.arange(len(used)), [len(grams[u]) for u in used])
            if len(of):
                np.add.at(g["gram"], [i for u in used for i in grams[u]], per_word[of, 3 + EMBEDDED :])
            g["word"][0] = g["gram"][0] = 0
            steps += 1
            for k, v in g.items():
                mean[k] += 0.1 * (v - mean[k])
                var[k] += 0.01 * (v * v - var[k])
                net.p[k] -= RATE * (mean[k] / (1 - 0.9**steps)) / (np.sqrt(var[k] / (1 - 0.99**steps)) + 1e-8)
                net.p[k] -= RATE * 0.01 * net.p[k]
            matrix[used] = _inputs(matrix[used], word[used], [grams[u] for u in used], net)
        matrix = np.concatenate([s.matrix(net) for s in sides])
    return vocabulary, net


def _inputs(x: np.ndarray, word: np.ndarray, grams: list[list[int]], net: Network) -> np.ndarray:
    """Inputs with the embeddings as they are now."""
    of = np.repeat(np.arange(len(grams)), [len(g) for g in grams])
    x[:, 3 : 3 + EMBEDDED], x[:, 3 + EMBEDDED :] = net.p["word"][word], 0
    if len(of):
        np.add.at(x[:, 3 + EMBEDDED :], of, net.p["gram"][[i for g in grams for i in g]])
    return x


class Scorer:
    """Scores texts; a distinct word's share of the gates is made once, its n-grams being found
    for many words in one scan."""

    def __init__(self, model: tuple[Vocabulary, Network]):
        import ahocorasick

        self.vocabulary, self.net = model
        self.grams = ahocorasick.Automaton()
        for gram, (number, _, _, odds) in self.vocabulary.grams.items():
            self.grams.add_word(gram, (number, odds))
        self.grams.make_automaton()
        self.forget()

    def forget(self) -> None:
        # Row 0 is padding. Written words, with what stands at their edges, know the row of their word.
        self.rows: dict[str, int] = {}
        self.written: dict[str, int] = {}
        self.gates = np.zeros((1 << 12, 6 * HIDDEN), np.float32)

    def _learn(self, fresh: list[str]) -> None:
        """Rows for written words that are new."""
        new = [w for w in dict.fromkeys(x.strip(EDGES) for x in fresh) if w not in self.rows]
        first = 1 + len(self.rows)
        self.rows.update(zip(new, range(first, first + len(new)), strict=True))
        self.written.update((x, self.rows[x.strip(EDGES)]) for x in fresh)
        if not new:
            return
        inputs = Words(self.vocabulary)
        line, ends = "".join(f"^{w}$\n" for w in new), np.cumsum([len(w) + 3 for w in new])
        found: list[dict[int, float]] = [{} for _ in new]
        # Words hold no line ends, so that no n-gram goes from one to the next.
        hits = list(self.grams.iter(line)) if len(self.grams) else []
        for k, (_, (number, odds)) in zip(np.searchsorted(ends, [e for e, _ in hits], "right").tolist(), hits, strict=True):
            found[k][number] = odds
        for w, parts in zip(new, found, strict=True):
            inputs.add(self.vocabulary.words.get(w), list(parts), list(parts.values()))
        if first + len(new) > len(self.gates):
            more = max(first + len(new), 2 * len(self.gates)) - len(self.gates)
            self.gates = np.concatenate((self.gates, np.zeros((more, 6 * HIDDEN), np.float32)))
        self.gates[first : first + len(new)] = self.net.gates(inputs.matrix(self.net, 1))

    def numbers(self, texts: list[list[str]]) -> list[np.ndarray]:
        """Rows of the written words of some texts."""
        known = self.written
        fresh = [w for w in set().union(*texts) if w not in known]
        if fresh:
            self._learn(sorted(fresh))
        return [np.fromiter(map(known.__getitem__, t), dtype=np.int64, count=len(t)) for t in texts]

    def logits(self, at: np.ndarray) -> np.ndarray:
        # Words of one place in their windows lie together, as the passes go from place to place.
        parts = np.array_split(at, -(-len(at) // WINDOWS_AT_ONCE))
        return np.concatenate([self.net.logits(self.gates[w.T].transpose(1, 0, 2), w > 0) for w in parts])

    def scores(self, texts: list[str | None]) -> list[float]:
        """Scores of a batch of texts, whose windows are taken together."""
        if len(self.written) > CACHE:
            self.forget()
        words = [(t or "").lower().split() for t in texts]
        held = [windows(n) for n in self.numbers(words)]
        if not held:
            return []
        found = self.logits(np.concatenate(held))
        first = np.concatenate(([0], np.cumsum([len(w) for w in held])[:-1]))
        score = sigmoid(np.maximum.reduceat(found.astype(np.float64), first))
        return np.where([len(w) > 0 for w in words], score, 0.0).tolist()


def sample(docs: DataFrame, labels: DataFrame) -> list[tuple[str, int]]:
    """(text, toxic) of the labelled documents to learn from, at most `MAX_TOXIC` and `MAX_CLEAN`."""
    known = labels.where(~held_out() & F.col("doc_id").isNotNull() & F.col("toxic").isNotNull())
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    some = lambda toxic, n: known.where((F.col("toxic") > 0) == F.lit(toxic)).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
    # As many rows as the two bounds allow.
    chosen = F.broadcast(some(True, MAX_TOXIC).unionByName(some(False, MAX_CLEAN)))
    texts = docs.select("doc_id", "text").where("length(text) <= %d" % MAX_CHARS).join(chosen, "doc_id")
    # Of rows that share an id some text, the least, so that reruns agree.
    rows = texts.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("toxic").alias("toxic")).orderBy("doc_id").collect()
    return [(r["text"], int(r["toxic"] > 0)) for r in rows]


OUT = "doc_id string, score double"


def score(docs: DataFrame, labels: DataFrame, least: float = 0.5) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted."""
    spark = docs.sparkSession
    model = train(sample(docs, labels))
    sent = spark.sparkContext.broadcast(model)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = sent.value
        scorer = None if isinstance(model, float) else Scorer(model)
        for part in parts:
            texts = part["text"].tolist()
            yield pd.DataFrame({"doc_id": part["doc_id"], "score": scorer.scores(texts) if scorer else [model] * len(texts)})

    arrow_rows(spark)
    found = as_longs(as_texts(docs.select("doc_id", "text"), "doc_id").mapInPandas(run, OUT), "doc_id")
    return found.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= least).cast("int").alias("predicted"))
