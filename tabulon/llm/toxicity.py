"""Toxicity by a weighted finite-state grammar over clauses.

Five sequential transducers are composed into one table: a lexicon maps tokens to symbols (insult of a
strength, threat, target, negation, report, other, clause end); the negation transducer marks insults
and threats that stand up to three tokens after a negation; the reported-speech transducer marks
those after a report word in their clause; the target transducer marks those with a person named up
to four tokens before them (a target after them raises the clause as well). The last transducer
weighs what comes out. A clause's score comes from its marked matches, not from single words, and a
document's features are sums over its clauses, to which a logistic model gives a score from 0 to 1.

Learning. From at most `max_toxic` + `max_clean` labelled rows (in the order of a hash of their id; a
documented bound, the fit alone uses it) the lexicon takes words and word beginnings whose distinct
contexts (word before, word after) are toxic beyond chance: evidence n * KL(rate || base) against
log(number of units) plus a margin. Copies of one text share their contexts and so count once.

Defined results: null, empty and white-space texts have no clause and get the model's base score;
equal texts get equal scores; every row of the input gives one row, repeated ids too; null ids are
scored, and held_out is then null. An empty table gives an empty result; without labelled rows the
seed lexicon and prior weights score. Only `doc_id` and `text` are read; the label table gives
`doc_id` and `toxic`, rows with nulls there are passed over, an id labelled twice counts as toxic if
any label says so.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, mix64

OTHER, END, WEAK, MID, STRONG, THREAT, TARGET, NEGATION, REPORT = range(9)
#: Small seed lists; what labels show is added to them.
SEED = {
    STRONG: "idiot moron scum stupid loser pathetic worthless disgusting trash clown imbecile vermin filth".split(),
    THREAT: "kill destroy hurt beat murder threaten attack".split(),
    TARGET: "you your yours u he she they them him her everyone people tu vous toi du ihr dich usted ustedes ellos".split(),
    NEGATION: "not no never isn't aren't wasn't don't doesn't cannot neither nor nicht kein keine jamais pas nunca".split(),
    REPORT: "said says called wrote quoted quote reported claimed alleged according told sagte schrieb dit dijo".split(),
}
#: One word rule for learning and scoring: letters, digits and _; `n't` stays with its word. Scoring also
#: takes clause marks, but not . and : between digits.
_WORD = re.compile(r"\w+(?:(?<=n)'t\b)?")
_TOKEN = re.compile(rf"{_WORD.pattern}|[!?;\n]|[.:](?!(?<=\d[.:])\d)")
#: Marked symbols that leave the cascade: plain, targeted, negated, reported insult; the same for threats.
FEATURES = ("insult", "insult_targeted", "insult_negated", "insult_reported", "threat", "threat_targeted", "threat_negated", "threat_reported")


class Transducer:
    """Sequential letter-to-letter transducer: `step(state, symbol) -> (state, output)`."""

    def __init__(self, start, step):
        self.start, self.step = start, step

    def compose(self, after: Transducer) -> Transducer:
        def step(state, symbol):
            a, mid = self.step(state[0], symbol)
            b, out = after.step(state[1], mid)
            return (a, b), out

        return Transducer((self.start, after.start), step)

    def table(self, symbols) -> tuple[np.ndarray, list]:
        """All reachable states: next[state, symbol] and outputs[state][symbol]."""
        seen, todo, nxt, outs = {self.start: 0}, [self.start], [], []
        for state in todo:
            row, out = [], []
            for s in symbols:
                to, o = self.step(state, s)
                if to not in seen:
                    seen[to] = len(seen)
                    todo.append(to)
                row.append(seen[to])
                out.append(o)
            nxt.append(row)
            outs.append(out)
        return np.array(nxt), outs


def _match(s) -> bool:
    return WEAK <= s[0] <= THREAT


def _tagged() -> Transducer:
    return Transducer(0, lambda q, s: (q, (s, frozenset())))


def _negation(reach: int = 3) -> Transducer:
    def step(left, s):
        if s[0] == END:
            return 0, s
        if s[0] == NEGATION:
            return reach, s
        return max(0, left - 1), (s[0], s[1] | {"negated"}) if left and _match(s) else s

    return Transducer(0, step)


def _report() -> Transducer:
    def step(on, s):
        if s[0] == END:
            return False, s
        return on or s[0] == REPORT, (s[0], s[1] | {"reported"}) if on and _match(s) else s

    return Transducer(False, step)


def _target(reach: int = 4) -> Transducer:
    """A target after a match, still in reach, comes out as a targeted weak match of its own."""

    def step(q, s):
        before, since = q
        if s[0] == END:
            return (0, 0), s
        if s[0] == TARGET:
            return (reach, 0), (WEAK, frozenset({"targeted"})) if since else s
        if _match(s):
            return (max(0, before - 1), reach), (s[0], s[1] | {"targeted"}) if before else s
        return (max(0, before - 1), max(0, since - 1)), s

    return Transducer((0, 0), step)


_STRENGTH = {WEAK: 0.35, MID: 0.7, STRONG: 1.0, THREAT: 1.0}


def _weigh() -> Transducer:
    """Output: (feature, weight) or None."""

    def step(q, s):
        if not _match(s):
            return q, None
        kind = "threat" if s[0] == THREAT else "insult"
        mark = next((f"_{m}" for m in ("negated", "reported", "targeted") if m in s[1]), "")
        return q, (FEATURES.index(kind + mark), _STRENGTH[s[0]])

    return Transducer(0, step)


@lru_cache(1)
def grammar() -> tuple[list[list[int]], list[list]]:
    nxt, outs = _tagged().compose(_negation()).compose(_report()).compose(_target()).compose(_weigh()).table(range(9))
    return nxt.tolist(), outs


class Lexicon(dict):
    """Word or clause mark to code (symbol, plus 16 where a clause ends after it), worked out once a token."""

    def __init__(self, words: dict[str, int], starts: dict[str, int], most: int = 150_000):
        super().__init__()
        self.words, self.starts, self.most = words, starts, most
        self.lengths = sorted({len(x) for x in starts})

    def __missing__(self, token: str) -> int:
        if len(self) >= self.most:
            self.clear()
        code = self.words.get(token, OTHER)
        for n in self.lengths if code == OTHER else ():
            if len(token) >= n and (hit := self.starts.get(token[:n])):
                code = hit
                break
        self[token] = code = code | (16 if token in ".!?;:\n" else 0)
        return code


_HIT = re.compile(rb"[\x02-\x05\x12-\x15]")


def clause_features(text: str | None, lexicon: Lexicon) -> list[float]:
    """Sum over clauses of the strongest match of each feature; few clauses hold a match, so only those are run."""
    out = [0.0] * len(FEATURES)
    codes = bytes(map(lexicon.__getitem__, _TOKEN.findall(text.lower()))) if text else b""
    at, hit = 0, _HIT.search(codes)
    if not hit:
        return out
    nxt, outs = grammar()
    ends = [m.end() for m in re.finditer(rb"[\x10-\x1f]", codes)] + [len(codes)]
    for end in ends:
        if hit is None:
            break
        if hit.start() < end:
            best, q = {}, 0
            for c in codes[at:end]:
                o = outs[q][c & 15]
                q = nxt[q][c & 15]
                if o and o[1] > best.get(o[0], 0):
                    best[o[0]] = o[1]
            for k, v in best.items():
                out[k] += v
            hit = _HIT.search(codes, end)
        at = end
    return out


@dataclass
class Model:
    words: dict[str, int] = field(default_factory=dict)
    starts: dict[str, int] = field(default_factory=dict)
    weights: np.ndarray = field(default_factory=lambda: np.array([5.0, 7.0, 1.0, 1.5, 2.0, 5.0, 0.5, 1.0]))
    bias: float = -3.0

    def lexicon(self) -> Lexicon:
        return Lexicon(self.words, self.starts)

    def scores(self, features: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(np.log1p(features) @ self.weights + self.bias, -30, 30)))


def _seed_words() -> dict[str, int]:
    return {w: k for k, ws in SEED.items() for w in ws}


def _evidence(pos: np.ndarray, neg: np.ndarray, base: float) -> np.ndarray:
    n = np.maximum(pos + neg, 1)
    r = np.clip((pos + 0.5) / (n + 1), 1e-9, 1 - 1e-9)
    return np.where(r > base, n * (r * np.log(r / base) + (1 - r) * np.log((1 - r) / (1 - base))), 0)


def learn(rows: list[tuple[str, int]], margin: float = 4.0, min_rate: float = 0.8, lengths: tuple[int, ...] = (4, 5, 6, 7)) -> Model:
    """Lexicon and weights from (text, toxic) rows."""
    vocab: dict[str, int] = {}
    codes, labels = array("i"), array("b")
    for text, toxic in rows:
        ids = [vocab.setdefault(w, len(vocab)) for w in _WORD.findall((text or "").lower())]
        codes.extend([-1, *ids])
        labels.extend([toxic] * (len(ids) + 1))
    model = Model(_seed_words())
    c, y = np.frombuffer(codes, np.int32).astype(np.int64), np.frombuffer(labels, np.int8)
    if len(c) and len(vocab):
        context = np.concatenate([[-1], c[:-1]]) * 1_000_003 + np.concatenate([c[1:], [-1]])
        real = c >= 0
        c, y = c[real], y[real]
        _, one = np.unique(mix64((context[real] * 2 + y).astype(np.uint64)) + c.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15), return_index=True)
        pos, neg = (np.bincount(c[one][y[one] == v], minlength=len(vocab)) for v in (1, 0))
        base = float(np.clip(pos.sum() / max(1, pos.sum() + neg.sum()), 0.01, 0.9))
        names = list(vocab)
        bar = np.log(len(names) * (1 + len(lengths))) + margin
        found: dict[str, int] = {}
        strength = lambda r: STRONG if r >= 0.95 else MID
        rate = pos / np.maximum(pos + neg, 1)
        good = (rate >= min_rate) & (_evidence(pos, neg, base) >= bar)
        for i in np.flatnonzero(good):
            if len(names[i]) >= 3 and model.words.get(names[i], OTHER) in (OTHER, STRONG):
                model.words[names[i]] = strength(rate[i])
        seeds = set(_seed_words())
        known = np.array([w in seeds for w in names])
        support: dict[str, float] = {}
        for n in sorted(lengths, reverse=True):  # beginnings that several words show; the longest that lose little
            at: dict[str, int] = {}
            group = np.array([at.setdefault(w[:n], len(at)) if len(w) > n and not known[i] else -1 for i, w in enumerate(names)])
            ok = group >= 0
            p, q, kinds = (np.bincount(group[ok], v[ok], len(at)) for v in (pos, neg, (pos > 0).astype(float)))
            r = p / np.maximum(p + q, 1)
            top = np.zeros(len(at))
            np.maximum.at(top, group[ok], pos[ok])
            good = (kinds >= 5) & (top <= 0.5 * p) & (r >= max(min_rate, 0.9)) & (_evidence(p, q, base) >= bar + margin)
            for u, i in at.items():
                if good[i]:
                    longer = [k for k in support if k.startswith(u)]
                    if p[i] * 0.9 > sum(support[k] for k in longer):
                        for k in longer:
                            del support[k], found[k]
                        support[u], found[u] = p[i], strength(r[i])
        for w, k in list(model.words.items()):  # seeds that the labels contradict
            if k in (STRONG, THREAT) and w in vocab and neg[vocab[w]] > 20 and rate[vocab[w]] < 2 * base:
                del model.words[w]
        model.starts = found
        model.words = {w: k for w, k in model.words.items() if k in (TARGET, NEGATION, REPORT) or not any(w[:n] in found for n in lengths)}
    lexicon = model.lexicon()
    x = np.log1p(np.array([clause_features(t, lexicon) for t, _ in rows]).reshape(-1, len(FEATURES)))
    t = np.array([v for _, v in rows], float)
    prior, beta = np.append(model.weights, model.bias), np.append(model.weights, model.bias)
    if len(t) and 0 < t.sum() < len(t):
        x1 = np.hstack([x, np.ones((len(x), 1))])
        for _ in range(25):
            s = 1 / (1 + np.exp(-np.clip(x1 @ beta, -30, 30)))
            g = x1.T @ (s - t) + 1.0 * (beta - prior)
            h = (x1 * (s * (1 - s))[:, None]).T @ x1 + np.eye(len(beta))
            beta = beta - np.linalg.solve(h, g)
    model.weights, model.bias = np.maximum(beta[:-1], 0), float(min(beta[-1], -0.5))
    return model


def train(docs: DataFrame, labels: DataFrame, max_toxic: int = 1500, max_clean: int = 3000, max_chars: int = 24_000_000) -> Model:
    """Fit on a bounded sample of labelled rows: so many of each label, and so many characters in all.

    Texts that pass the bound together are cut to a common length (max_chars halved until they fit); no row
    is left out, and their scores are of the whole texts.
    """
    y = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    pick = lambda v, n: y.where(F.col("toxic") == v).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
    ids = [r[0] for v, n in ((1, max_toxic), (0, max_clean)) for r in pick(v, n).select("doc_id").collect()]
    marks = docs.sparkSession.createDataFrame([(i,) for i in ids], "doc_id long") if ids else None
    if marks is None:
        return learn([])
    # at most max_toxic + max_clean ids: safe to broadcast
    found = docs.select("doc_id", "text").join(F.broadcast(marks), "doc_id").join(y, "doc_id").where("text is not null").groupBy("doc_id").agg(F.min("text").alias("text"), F.first("toxic").alias("toxic"))
    rows, total, share = [], 0, max_chars
    for r in found.orderBy(F.xxhash64("doc_id"), "doc_id").select("text", "toxic").toLocalIterator():
        rows.append((r[0][:share], int(r[1] > 0)))
        total += len(rows[-1][0])
        while total > max_chars:
            share //= 2
            rows = [(t[:share], y) for t, y in rows]
            total = sum(len(t) for t, _ in rows)
    return learn(rows)


def _score(batches: Iterator[pa.RecordBatch], words: dict, starts: dict, weights: np.ndarray, bias: float) -> Iterator[pa.RecordBatch]:
    model = Model(words, starts, weights, bias)
    lexicon = model.lexicon()
    for batch in batches:
        if not batch.num_rows:
            continue
        f = np.array([clause_features(t.as_py(), lexicon) for t in batch.column("text")])
        s = model.scores(f)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(s), pa.array(f.sum(axis=1))], names=["doc_id", "score", "matched"])


def _keep(batches: Iterator[pa.RecordBatch], model: Model, below: float) -> Iterator[pa.RecordBatch]:
    lexicon = model.lexicon()
    for batch in batches:
        if batch.num_rows:
            f = np.array([clause_features(t.as_py(), lexicon) for t in batch.column("text")])
            yield batch.filter(pa.array(model.scores(f) < below))


def score(docs: DataFrame, model: Model, keep_below: float | None = None) -> DataFrame:
    """doc_id, score, matched (weight of matched clauses) of each row; or the rows themselves that score below a bound."""
    if keep_below is not None:
        return docs.mapInArrow(lean(lambda it: _keep(it, model, keep_below)), docs.schema)
    kind = docs.schema["doc_id"].dataType.simpleString()
    w, s, c, b = model.words, model.starts, model.weights, model.bias
    return docs.select("doc_id", "text").mapInArrow(lean(lambda it: _score(it, w, s, c, b)), f"doc_id {kind}, score double, matched double")


def held_out(doc_id="doc_id"):
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(5)) == 0


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted: labels of held-out rows never reach the fit."""
    model = train(docs, labels.where(~held_out()))
    out = score(docs, model)
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
