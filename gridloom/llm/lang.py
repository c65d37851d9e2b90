"""Language of documents and of their stretches, where labels are missing or wrong.

Hierarchical discrimination by linear support vector machines over hashed word
and letter n-gram features.  One machine decides the language family first: a
Viterbi pass over the words' family scores cuts a text into stretches of one
family.  Within them one-versus-one machines separate the related languages: a
second pass sees only the languages of the family decided.  Changing costs
more inside a sentence than between sentences, and capitalised words inside a
sentence count little, so names of people, teams and places start no stretch
of their own.  The texts of a batch are walked side by side in numpy.

The machines are fitted on a bounded sample: the ``SAMPLE`` labelled documents
of 40 to 2,000 characters with the smallest hash of their id, at most about
``PER_LANGUAGE`` sentences of a language, and the seed words below.  Documents
that the seed words alone assign to another language than their label are left
out, as labels may be wrong.  Everything else covers all documents and whole
texts.

Defined results: null, empty and blank texts and texts without words have no
segment; a document without words is never reported; without labelled rows
the seed words alone decide; ties go to the language that the last word
favoured; further columns are ignored; rows that repeat an id repeat their
segments.
"""

from __future__ import annotations

import math
import re
import unicodedata
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.sources.tables import spread

FAMILIES = {"germanic": ("de", "en", "nl"), "romance": ("es", "fr", "it", "pt")}
LANGUAGES = tuple(sorted(x for f in FAMILIES.values() for x in f))
SAMPLE = 4000  # labelled documents at most that the machines are fitted on
PER_LANGUAGE = 1400  # sentences of a language in the fit, and those of the document that reaches it
DIM = 1 << 15
WITHIN, BETWEEN, BREAK = 9.0, 2.6, 2.2  # cost of a change inside a sentence, between sentences, at a line break

#: common words of each language, the seed of every fit; fixed values
SEEDS = {
    "de": "der die das und ist nicht ein eine auf mit sich des dem den von zu im war wurde hatte noch auch aus bei nach über für vor unter wie dass er sie es wir ich ihr sein werden wenn aber oder nur",
    "en": "the of and to in is was that it with as for on by at from this had not but were which have has their his her they you what there been would more when who will no out so said",
    "nl": "de het een en van in is dat op te met voor niet zijn was aan er om ook als bij uit naar door maar over dan nog wel geen werd deze hun zij hij wat heeft hadden toen waren onder veel",
    "es": "el la los las de que y en un una es no se por con para su al lo como más pero sus le ya fue era este ha sí porque esta son entre cuando muy sin sobre también hasta hay donde",
    "fr": "le la les de des et en un une est que qui dans pour pas au sur ce il elle ne se plus par avec sont son sa ses mais ou aux ont été était cette nous vous leur comme tout fait deux",
    "it": "il lo la gli le di che e è un una in non per del della con si da al sono nel alla come più ma anche suo sua era ha dei delle questo quando molto tutti dopo essere stata stato dal",
    "pt": "o a os as de que e do da em um uma não é com para se por mais dos das no na como mas foi ao ele ela seu sua ou quando muito nos já eu também só pelo pela até isso depois era são",
}

_NAMES = {
    "de": "de deu ger deutsch german allemand", "en": "en eng english englisch anglais ingles inglese", "nl": "nl nld dut nederlands dutch niederlandisch",
    "es": "es spa esp espanol spanish castellano spanisch", "fr": "fr fra fre francais french franzosisch", "it": "it ita italiano italian italienisch", "pt": "pt por portugues portuguese portugiesisch",
}
LABELS = {name: lang for lang, names in _NAMES.items() for name in names.split()}
#: labels that name no language
NO_LANGUAGE = frozenset("und xx mul zxx mis unknown none null n/a na ? - other misc".split()) | {""}

_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
_LINK = re.compile(r"(?:https?://|www\.)\S+|[@#]\w+|(?<!\S)\S+@\S+\.\w+")
_LINK_SIGN = re.compile(r"[@#]|://|www\.")
NAME_WEIGHT = 0.2  # weight of capitalised words inside a sentence
BOUNDS = np.array([3.0, *[3.0] * 7])  # of one word's scores: family, languages
KEPT = 100_000  # words whose scores a worker remembers
LEAST_WORDS = 3  # words that are no names in a stretch of its own
CHARS = 2_000_000  # characters that are scored at once, a longer text excepted
TOGETHER = 24  # texts that are walked side by side at least; fewer are walked one by one

_END = re.compile(r"[.!?…]+[\"”»«')]*(?=\s|$)|:\s|;\s|\n+|[\"”»]\s")
_INVISIBLE = re.compile("[​‌‍⁠﻿­]")


def read_label(label: str | None) -> str | None:
    """A language code, '' for a label that names none, None for one that names another language than the seven."""
    if label is None:
        return ""
    flat = "".join(c for c in unicodedata.normalize("NFKD", label) if not unicodedata.combining(c)).strip().lower()
    if flat in NO_LANGUAGE:
        return ""
    return LABELS.get(flat) or LABELS.get(re.split(r"[-_ (]", flat)[0])


def prepare(text: str) -> str:
    """Composed letters, no invisible characters, one kind of line end."""
    return unicodedata.normalize("NFC", _INVISIBLE.sub("", text)).replace("\r\n", "\n").replace("\r", "\n")


def features(word: str) -> np.ndarray:
    """Hashed features of one lower-case word: itself and its letter n-grams up to four."""
    padded = f"^{word}$"
    grams = {word + "#"}
    for n in (2, 3, 4):
        grams.update([padded[i : i + n] for i in range(len(padded) - n + 1)])
    return np.array([zlib.crc32(g.encode("utf-8", "surrogatepass")) % DIM for g in grams], dtype=np.int64)


#: the machines: the family, then each two languages of one family; a positive margin speaks for germanic, or for the first of the two
MACHINES = (("germanic", "romance"), *((a, b) for own in FAMILIES.values() for a in own for b in own if a < b))
#: the places of a family's languages; three or four each
SLOTS = tuple(tuple(LANGUAGES.index(x) for x in own) for own in FAMILIES.values())
_FAMILY = np.array([0 if x in FAMILIES["germanic"] else 1 for x in LANGUAGES])
_SLOT = np.array([SLOTS[f].index(i) for i, f in enumerate(_FAMILY)])


def _margins_to_scores() -> np.ndarray:
    """Matrix from the machines' margins to the family's score and each language's mean score against its relatives."""
    out = np.zeros((len(MACHINES), 1 + len(LANGUAGES)))
    out[0, 0] = 1.0
    for m, (a, b) in enumerate(MACHINES[1:], 1):
        rivals = sum(f == _FAMILY[LANGUAGES.index(a)] for f in _FAMILY) - 1
        out[m, 1 + LANGUAGES.index(a)], out[m, 1 + LANGUAGES.index(b)] = 1.0 / rivals, -1.0 / rivals
    return out


_TO_SCORES = _margins_to_scores()


class Model:
    """Weights of all machines (``DIM`` rows), and the scores of the words met so far."""

    def __init__(self, weights: np.ndarray) -> None:
        self.weights = weights
        self.known: dict[str, int] = {}
        self.table = np.zeros((0, 1 + len(LANGUAGES)))

    def scores(self, words: list[str]) -> np.ndarray:
        """A row for each word: its score for germanic (less than 0: romance), then each language's within its family."""
        at = list(map(self.known.get, words))
        if None in at:
            if len(self.known) > KEPT:
                self.known, self.table = {}, self.table[:0]
            self._learn([w for w in dict.fromkeys(words) if w not in self.known])
            at = list(map(self.known.get, words))
        return self.table[np.array(at, dtype=np.int64)]

    def _learn(self, words: list[str]) -> None:
        rows = []
        for i in range(0, len(words), 20_000):
            found = [features(w.lower()) for w in words[i : i + 20_000]]
            n = np.array(list(map(len, found)))
            sums = np.add.reduceat(self.weights[np.concatenate(found)], np.cumsum(n) - n, axis=0)
            rows.append((sums / np.sqrt(n)[:, None]) @ _TO_SCORES)
        self.known.update(zip(words, range(len(self.known), len(self.known) + len(words))))
        self.table = np.concatenate([self.table, *rows])


def sentences(text: str) -> list[list[str]]:
    """Lower-case words of each sentence of three words or more."""
    return [w for part in _END.split(text) if len(w := _WORD.findall(part.lower())) > 2]


Row = tuple[np.ndarray, np.ndarray]


def _fit_binary(rows: list[Row], y: np.ndarray, epochs: int = 12, rate: float = 0.5, decay: float = 1e-4, batch: int = 32) -> np.ndarray:
    """Averaged stochastic subgradient descent on the hinge loss, a few rows a step."""
    w, mean = np.zeros(DIM), np.zeros(DIM)
    order = np.random.Generator(np.random.PCG64(7))
    sizes = np.array([len(idx) for idx, _ in rows])
    for e in range(epochs):
        step = rate / (1 + e)
        shuffled = order.permutation(len(rows))
        for at in range(0, len(rows), batch):
            take = shuffled[at : at + batch]
            idx, val = np.concatenate([rows[i][0] for i in take]), np.concatenate([rows[i][1] for i in take])
            n, its = sizes[take], y[take]
            margin = its * np.add.reduceat(w[idx] * val, np.cumsum(n) - n)
            np.add.at(w, idx, np.repeat(np.where(margin < 1.0, step * its, 0.0), n) * val)
        w *= 1 - decay
        if e >= epochs // 2:
            mean += w
    return mean / max(1, epochs - epochs // 2)


def _rows(data: list[list[str]]) -> list[Row]:
    """Mean of the words' feature vectors of each sentence, as their scores are averaged too; features may repeat."""
    known: dict[str, Row] = {}
    out = []
    for words in data:
        found = []
        for w in words:
            if (f := known.get(w)) is None:
                idx = features(w)
                f = known[w] = idx, np.full(len(idx), 1.0 / math.sqrt(len(idx)))
            found.append(f)
        out.append((np.concatenate([i for i, _ in found]), np.concatenate([v for _, v in found]) / len(words)))
    return out


def _fit_all(rows: list[Row], langs: list[str]) -> Model:
    names = [(f"{'germanic' if x in FAMILIES['germanic'] else 'romance'}", x) for x in langs]
    columns = []
    for a, b in MACHINES:
        use = [i for i, n in enumerate(names) if a in n or b in n]
        columns.append(_fit_binary([rows[i] for i in use], np.array([1.0 if a in names[i] else -1.0 for i in use])))
    return Model(np.stack(columns, axis=1).astype("float32"))


def choose(scores: np.ndarray) -> int:
    """The language of summed word scores: first the family, then the best within it."""
    own = SLOTS[0] if scores[0] >= 0 else SLOTS[1]
    return max(own, key=lambda k: scores[1 + k])


def train(labelled: list[tuple[str, str]]) -> Model:
    """Fit on (text, language) pairs; texts that the seed words alone contradict are left out, as labels may be wrong."""
    data: list[tuple[list[str], str]] = []
    for lang, words in SEEDS.items():
        w = words.split()
        data += [(w[i : i + 8], lang) for i in range(0, len(w), 4)]
    n = len(data)
    first = _fit_all(_rows([s for s, _ in data]), [x for _, x in data])
    count = dict.fromkeys(LANGUAGES, 0)
    for text, lang in labelled:
        if count[lang] < PER_LANGUAGE and (own := sentences(prepare(text))):
            if LANGUAGES[choose(first.scores([w for s in own for w in s]).sum(axis=0))] == lang:
                data += [(s, lang) for s in own]
                count[lang] += len(own)
    return first if len(data) == n else _fit_all(_rows([s for s, _ in data]), [x for _, x in data])


LETTER, UPPER, LOWER, APOSTROPHE, STARTER, NEWLINE, STOP, SOFT = (1 << i for i in range(8))
_CLASSES = 0x32400  # no letters beyond


@lru_cache(1)
def _classes() -> np.ndarray:
    """What each character is, as bits."""
    out = np.zeros(_CLASSES + 1, dtype=np.uint8)
    for i in range(_CLASSES):
        c = chr(i)
        if c.isalnum() and not c.isdecimal():
            out[i] = LETTER | (UPPER if c.isupper() else 0) | (LOWER if c.islower() else 0)
    for bit, signs in ((APOSTROPHE, "'’"), (STARTER, '.!?…:\n«„“"'), (NEWLINE, "\n"), (STOP, ".!?…"), (SOFT, ':;"”»«')):
        for c in signs:
            out[ord(c)] |= bit
    return out


def _flags(text: str) -> np.ndarray:
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    return _classes()[np.minimum(codes, _CLASSES)]


def _absorb(path: list[int], names: list[bool]) -> list[int]:
    """Join stretches with fewer than ``LEAST_WORDS`` words other than names to the neighbour before, else after."""
    if path.count(path[0]) == len(path):
        return path
    runs: list[list[int]] = []  # state, words, telling words
    for s, name in zip(path, names):
        if runs and runs[-1][0] == s:
            runs[-1][1] += 1
            runs[-1][2] += not name
        else:
            runs.append([s, 1, int(not name)])
    while len(runs) > 1:
        i = min(range(len(runs)), key=lambda k: runs[k][2])
        if runs[i][2] >= LEAST_WORDS:
            break
        k = i - 1 if i else 1
        if 0 < i < len(runs) - 1 and runs[i + 1][2] > runs[i - 1][2]:
            k = i + 1
        runs[k][1] += runs[i][1]
        runs[k][2] += runs[i][2]
        del runs[i]
        merged: list[list[int]] = []
        for r in runs:
            if merged and merged[-1][0] == r[0]:
                merged[-1][1] += r[1]
                merged[-1][2] += r[2]
            else:
                merged.append(r)
        runs = merged
    return [s for s, n, _ in runs for _ in range(n)]


class _Walk:
    """The words of several texts ordered by their place in the text, so that all texts are walked side by side.

    The place ``t`` of all texts of more than ``t`` words, longest text first,
    stands in ``offset[t] : offset[t + 1]``.  Where fewer than ``TOGETHER``
    texts go on, each is walked to its end alone.
    """

    def __init__(self, first: np.ndarray, count: np.ndarray) -> None:
        self.first, self.count = first, count
        self.order = np.argsort(-count, kind="stable")
        rank = np.empty(len(count), dtype=np.int64)
        rank[self.order] = np.arange(len(count))
        long = count[self.order]
        self.steps = int(long[TOGETHER - 1]) if len(count) >= TOGETHER else 0
        self.width = np.searchsorted(-long, -np.arange(self.steps), side="left")  # texts of more than t words
        self.offset = np.concatenate([[0], np.cumsum(self.width)])
        place = np.arange(int(count.sum())) - np.repeat(first, count)
        self.early = np.flatnonzero(place < self.steps)
        self.at = self.offset[place[self.early]] + np.repeat(rank, count)[self.early]
        self.rest = [int(d) for d in self.order if count[d] > self.steps]

    def best(self, scores: np.ndarray, cost: np.ndarray) -> np.ndarray:
        """The path of states with the greatest sum of scores less the costs of changes."""
        n, states = scores.shape
        path = np.empty(n, dtype=np.int64)
        total, steps = int(self.offset[-1]), self.steps
        s, c = np.empty((states, total)), np.empty(total)
        s[:, self.at], c[self.at] = scores[self.early].T, cost[self.early]
        came, stay = np.zeros(total, dtype=np.int64), np.ones((states, total), dtype=bool)
        v = s[:, : self.width[0]].copy() if steps else None
        for t in range(1, steps):
            a, b = self.offset[t], self.offset[t + 1]
            x = v[:, : b - a]
            came[a:b] = x.argmax(axis=0)
            edge = x.max(axis=0) - c[a:b]
            np.greater_equal(x, edge, out=stay[:, a:b])
            np.maximum(x, edge, out=x)
            x += s[:, a:b]
        state = v.argmax(axis=0) if steps else None
        for k, d in enumerate(self.rest):
            a, b = self.first[d] + steps, self.first[d] + self.count[d]
            own, before = _alone(v[:, k].tolist() if steps else None, scores[a:b].tolist(), cost[a:b].tolist())
            path[a:b] = own
            if steps:
                state[k] = before
        done = np.empty(total, dtype=np.int64)
        for t in range(steps - 1, -1, -1):
            a, b = self.offset[t], self.offset[t + 1]
            now = state[: b - a]
            done[a:b] = now
            now[:] = np.where(stay[now, np.arange(a, b)], now, came[a:b])
        path[self.early] = done[self.at]
        return path


def _alone(v: list[float] | None, scores: list[list[float]], costs: list[float]) -> tuple[list[int], int]:
    """The best path of one text's words from the sums ``v`` on, and the state before the first of them."""
    back: list[tuple[int, float, list[float]]] = []
    for e, cost in zip(scores, costs):
        if v is None:
            v = e
            continue
        top = max(v)
        edge = top - cost
        back.append((v.index(top), edge, v))
        v = [(x if x >= edge else edge) + s for x, s in zip(v, e)]
    state = v.index(max(v))
    path = [state]
    for best, edge, before in reversed(back):
        if before[state] < edge:
            state = best
        path.append(state)
    path.reverse()
    return (path, path[0]) if len(path) == len(scores) else (path[1:], path[0])


Stretch = tuple[int, int, str, float]


def _segment(texts: list[str], plains: list[str], model: Model) -> list[list[Stretch]]:
    """The stretches of prepared texts that all have words; ``plains`` are the texts with links blanked."""
    text, plain = "\n".join(texts), "\n".join(plains)
    shown = _flags(plain)
    said = shown if plain == text else _flags(text)
    begin = np.cumsum([0, *(len(t) + 1 for t in texts)])[:-1]
    inside = (shown & LETTER) > 0
    marks = np.flatnonzero(shown & APOSTROPHE)
    marks = marks[(marks > 0) & (marks < len(shown) - 1)]
    inside[marks[((shown[marks - 1] & LETTER) > 0) & ((shown[marks + 1] & LETTER) > 0)]] = True
    turns = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    start, end = turns[::2], turns[1::2]
    words = _WORD.findall(plain)
    first = np.searchsorted(start, begin)
    count = np.diff(np.append(first, len(start)))
    doc = np.repeat(np.arange(len(texts)), count)
    gap = np.concatenate([[0], end[:-1]])
    gap[first] = begin
    fresh = np.zeros(len(start), dtype=bool)
    fresh[first] = True

    def holds(bit: int) -> np.ndarray:
        """Whether the gap before each word holds such a character."""
        seen = np.concatenate([[0], np.cumsum((said & bit) > 0, dtype=np.int64)])
        return seen[start] > seen[gap]

    cost = np.select([holds(NEWLINE), holds(STOP), holds(SOFT)], [BREAK, BETWEEN, WITHIN - 3.0], WITHIN)
    # names: capitalised inside a sentence, or before another such word at its start; in texts all in capitals case says nothing
    loud = np.add.reduceat(((shown & LOWER) > 0).astype(np.int64), begin) < 0.5 * np.add.reduceat(inside.astype(np.int64), begin)
    caps = ((shown[start] & UPPER) > 0) & ~loud[doc]
    opening = fresh | holds(STARTER)
    within = caps & ~opening
    followed = np.append(within[1:] & ~fresh[1:], False)
    names = caps & (~opening | (followed & (end - start > 1)))
    score = model.scores(words)
    score = np.where(names[:, None], NAME_WEIGHT * score, np.clip(score, -BOUNDS, BOUNDS))

    walk = _Walk(first, count)
    family = walk.best(np.stack([score[:, 0], -score[:, 0]], axis=1), cost)
    slots = np.full((len(score), max(map(len, SLOTS))), -1e9)
    for f, own in enumerate(SLOTS):
        rows = np.flatnonzero(family == f)
        slots[rows[:, None], np.arange(len(own))] = score[rows][:, [1 + k for k in own]]
    changed = np.append(False, family[1:] != family[:-1])
    slot = walk.best(slots, np.where(changed, 0.0, cost))  # a change of family is paid for already
    lang = np.array([[*own, -1][:4] for own in SLOTS])[family, slot]

    mixed = np.unique(doc[np.flatnonzero((lang[1:] != lang[:-1]) & ~fresh[1:])])
    for d in mixed:
        a, b = first[d], first[d] + count[d]
        lang[a:b] = _absorb(lang[a:b].tolist(), names[a:b].tolist())
    heads = np.flatnonzero(fresh | np.append(True, lang[1:] != lang[:-1]))
    sums, n = np.add.reduceat(score, heads, axis=0), np.diff(np.append(heads, len(start)))
    out: list[list[Stretch]] = [[] for _ in texts]
    tails = np.append(heads[1:], len(start)) - 1
    for d, a, z, k, total, m in zip(doc[heads].tolist(), start[heads].tolist(), end[tails].tolist(), lang[heads].tolist(), sums.tolist(), n.tolist()):
        own = SLOTS[_FAMILY[k]]
        rival = max(total[1 + j] for j in own if j != k)
        sure = _sigmoid(2.0 * (total[0] if _FAMILY[k] == 0 else -total[0]) / math.sqrt(m)) * _sigmoid((total[1 + k] - rival) / math.sqrt(m))
        out[d].append((a - int(begin[d]), z - int(begin[d]), LANGUAGES[k], sure))
    return out


def _sigmoid(x: float) -> float:
    return 1.0 / (1.0 + math.exp(-max(-30.0, min(30.0, x))))


def segment_all(texts: Iterable[str | None], model: Model) -> list[list[Stretch]]:
    """For each text its longest stretches in one language (start, end, language, confidence); offsets in the prepared text.

    The family is decided for every word by a first pass over all words, the
    language within it by a second; the confidence is the product of both.
    """
    out: list[list[Stretch]] = []
    at: list[int] = []
    own: list[str] = []
    plains: list[str] = []
    size = 0

    def flush() -> None:
        nonlocal size
        if own:
            for i, found in zip(at, _segment(own, plains, model)):
                out[i] = found
        at.clear(), own.clear(), plains.clear()
        size = 0

    for i, text in enumerate(texts):
        out.append([])
        if not text:
            continue
        text = prepare(text)
        plain = text
        if _LINK_SIGN.search(text):
            plain = _LINK.sub(lambda m: " " * len(m[0]), text)
            if not _WORD.search(plain):
                plain = text
        if not _WORD.search(plain):
            continue
        if size + len(text) > CHARS:
            flush()
        at.append(i)
        own.append(text)
        plains.append(plain)
        size += len(text)
    flush()
    return out


def segments(text: str | None, model: Model) -> list[Stretch]:
    """The stretches of one text."""
    return segment_all([text], model)[0]


def fit_on(df: DataFrame, id_: str, text: str, label: str, sample: int = SAMPLE) -> Model:
    """The model fitted on the bounded sample of labelled rows."""
    rows = df.select(F.col(id_).alias("i"), F.col(text).alias("t"), F.lower(F.trim(F.col(label))).alias("l"))
    rows = rows.where(F.col("l").isin(*LANGUAGES) & F.length("t").between(40, 2000))
    picked = rows.orderBy(F.xxhash64("i"), "i").limit(sample).select("t", "l").collect()
    return train([(r["t"], r["l"]) for r in picked])


def label_segments(df: DataFrame, id_: str, text: str, label: str, model: Model | None = None) -> DataFrame:
    """(id, seg_no, lang, start, end, confidence, state) of every stretch of every document.

    ``state`` is ``missing``, ``wrong``, ``mixed`` or ``right`` of the document's label.
    """
    model = model or fit_on(df, id_, text, label)
    shared = df.sparkSession.sparkContext.broadcast(model.weights)  # ten machines of 128 KB

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = Model(shared.value)
        for b in batches:
            rows = []
            for k, found, tag in zip(b["k"], segment_all(b["t"], own), b["l"]):
                if not found:
                    continue
                read = read_label(tag)
                state = "mixed" if len({x[2] for x in found}) > 1 else "missing" if read == "" else "right" if read == found[0][2] else "wrong"
                rows += [(k, i, lang, a, z, sure, state) for i, (a, z, lang, sure) in enumerate(found, 1)]
            yield pd.DataFrame(rows, columns=["k", "seg_no", "lang", "start", "end", "confidence", "state"]).astype({"k": "int64", "seg_no": "int32", "lang": "object", "start": "int32", "end": "int32", "confidence": "float64", "state": "object"})

    rows = df.select(F.col(id_).cast("bigint").alias("k"), F.col(text).cast("string").alias("t"), F.col(label).cast("string").alias("l")).where(F.col("k").isNotNull() & F.col("t").isNotNull())
    out = spread(rows).mapInPandas(run, "k bigint, seg_no int, lang string, start int, end int, confidence double, state string")
    return out.withColumnRenamed("k", id_)
