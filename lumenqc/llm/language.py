"""Language identification by segmentation-marginalised unigrams.

Over a fixed public piece vocabulary each language has piece probabilities.  A word's probability is the sum,
over all ways to cut it into pieces, of the product of theirs (forward algorithm); a text's is the product
over its words.  Expectation maximisation estimates the probabilities: forward-backward over counted word
types gives expected piece counts, which Spark sums by language and piece.  So what returns to the driver has
at most vocabulary x languages rows, and so has the model that tasks receive.

Words are runs of letters, lower-cased; runs over ``LONGEST`` letters are cut into runs of that many.

The word counts come from a sample of labelled rows: all, if there are up to ``max_rows``, else those whose
id hashes under max_rows / rows.  Prediction reads every text whole.

Special cases: a null text, or one without a letter, is ``und`` with score 0; ties take the first language by
name; rows of null text or language teach nothing; with nothing to learn from, every row is ``und``; repeated rows
repeat their result; very long texts are scored whole; an empty table gives an empty result; other columns are ignored, whatever
their names.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenqc.llm.common import lots, slices, sole, written

LETTERS = re.compile(r"[^\W\d_]+")
LONGEST = 32
#: Entries that a worker keeps of words it has scored; beyond, it starts anew.
CACHE = 400_000

class Vocabulary:
    """Pieces by a 64-bit polynomial hash, so that all substrings of many words are looked up at once."""

    BASE, BITS = np.uint64(0x9E3779B97F4A7C15 | 1), 18  # tables of 3 MB

    def __init__(self, path: str) -> None:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = {sp.id_to_piece(i): i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_byte(i) or sp.is_unknown(i))}
        self.size = sp.get_piece_size()
        self.unknown, self.none = self.size, self.size + 1  # a character that is no piece; no piece at all
        self.longest = max(map(len, pieces))
        self.lengths = np.ones(self.size + 2)
        keys, ids = [], []
        for n in range(1, self.longest + 1):
            of = [x for x in pieces if len(x) == n]
            if of:
                codes = np.array([list(map(ord, x)) for x in of], np.uint64)
                keys.append(self.substring(self.prefixes(codes), 0, n))
                ids.append(np.array([pieces[x] for x in of]))
                self.lengths[ids[-1]] = n
        self.tables = []  # a key that finds its slot taken goes to the next table
        key, value = np.concatenate(keys), np.concatenate(ids).astype(np.int32)
        while len(key):
            slots, hashes, values = self.slot(key), np.zeros(1 << self.BITS, np.uint64), np.full(1 << self.BITS, self.none, np.int32)
            first = np.unique(slots, return_index=True)[1]
            hashes[slots[first]], values[slots[first]] = key[first], value[first]
            self.tables.append((hashes, values))
            key, value = np.delete(key, first), np.delete(value, first)

    def slot(self, key: np.ndarray) -> np.ndarray:
        return ((key ^ (key >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(64 - self.BITS)

    def prefixes(self, codes: np.ndarray) -> list[np.ndarray]:
        out = [np.zeros(len(codes), np.uint64)]
        for k in range(codes.shape[1]):
            out.append(out[-1] * self.BASE + codes[:, k])
        return out

    def substring(self, prefixes: list[np.ndarray], a: int, b: int) -> np.ndarray:
        power = np.uint64(1)
        with np.errstate(over="ignore"):
            for _ in range(b - a):
                power = power * self.BASE
        return prefixes[b] - prefixes[a] * power

    def lattice(self, words: list[str]) -> list[tuple[int, int, np.ndarray, np.ndarray]]:
        """(start, end, rows, pieces) over words of one length: rows[i] of them has pieces[i] there."""
        n = len(words[0])
        prefixes = self.prefixes(np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4").reshape(-1, n).astype(np.uint64))
        out = []
        for b in range(1, n + 1):
            for a in range(max(0, b - self.longest), b):
                key = self.substring(prefixes, a, b)
                slot = self.slot(key)
                found = np.full(len(words), self.unknown if b - a == 1 else self.none, np.int32)
                for hashes, values in self.tables:
                    found = np.where(hashes[slot] == key, values[slot], found)
                rows = np.flatnonzero(found != self.none)
                if len(rows):
                    out.append((a, b, rows, found[rows]))
        return out


def vocabulary(path: str) -> Vocabulary:
    """Read once in each Python worker."""
    return sole(("pieces", path), lambda: Vocabulary(path))


def alike(found: list[str], most: int = 20_000) -> Iterator[np.ndarray]:
    """Indices of words of one length, at most so many at a time."""
    length = np.fromiter(map(len, found), np.int64, len(found))
    order = np.argsort(length, kind="stable")
    for same in np.split(order, np.flatnonzero(np.diff(length[order])) + 1):
        for at in range(0, len(same), most):
            yield same[at : at + most]


def words(chunk: str) -> list[str]:
    """The marked words of a space-free chunk."""
    out = []
    for run in LETTERS.findall(chunk.lower()):
        run = run if run.isalpha() else "".join(filter(str.isalpha, run))
        out += ["▁" + run[i : i + LONGEST] for i in range(0, len(run), LONGEST)]
    return out


@dataclass
class Model:
    """p: probabilities by piece (then the unknown character, then no piece) and language."""

    langs: list[str]
    p: np.ndarray
    path: str

    def forward(self, lattice: list, words: int, n: int) -> list[np.ndarray]:
        """By place in the words: the summed probability of all segmentations up to there, words x languages."""
        total = [np.zeros((words, len(self.langs))) for _ in range(n + 1)]
        total[0][:] = 1.0
        for a, b, rows, found in lattice:  # by end, so total[a] is complete
            total[b][rows] += total[a][rows] * self.p[found]
        return total

    def scores(self, found: list[str]) -> np.ndarray:
        """Log-probabilities, words x languages."""
        out = np.zeros((len(found), len(self.langs)))
        for at in alike(found):
            some = [found[i] for i in at.tolist()]
            out[at] = np.log(np.maximum(self.forward(vocabulary(self.path).lattice(some), len(some), len(some[0]))[-1], 1e-300))
        return out

    def expected(self, found: list[str], counts: np.ndarray, lang: int) -> np.ndarray:
        """Expected uses of each piece in the counted words of a language (forward-backward)."""
        one = Model([self.langs[lang]], self.p[:, lang : lang + 1], self.path)
        uses = np.zeros(len(self.p))
        for at in alike(found):
            some, n = [found[i] for i in at.tolist()], len(found[at[0]])
            lattice = vocabulary(self.path).lattice(some)
            ahead, back = one.forward(lattice, len(some), n), [np.zeros((len(some), 1)) for _ in range(n + 1)]
            back[n][:] = 1.0
            for a, b, rows, k in reversed(lattice):
                back[a][rows] += one.p[k] * back[b][rows]
            scale = counts[at] / np.maximum(ahead[n][:, 0], 1e-300)
            for a, b, rows, k in lattice:
                uses += np.bincount(k, (ahead[a][rows] * one.p[k] * back[b][rows])[:, 0] * scale[rows], len(uses))
        return uses


def word_counts(labelled: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    """(lang, word, n) over all rows; each task counts before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            by: dict[str, Counter] = {}
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                by.setdefault(lang, Counter()).update(text.split())
            for lang, chunks in by.items():
                n: Counter = Counter()
                for chunk, k in chunks.items():
                    for w in words(chunk):
                        n[w] += k
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(n), pa.string()), pa.array(list(n), pa.string()), pa.array(list(n.values()), pa.int64())], names=["lang", "word", "n"])

    made = labelled.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).mapInArrow(run, "lang string, word string, n long")
    return made.groupBy("lang", "word").agg(F.sum("n").alias("n"))


def train(
    docs: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
    max_rows: int = 20_000, rounds: int = 2, smoothing: float = 0.05,
) -> Model | None:
    """The model from rows with text and language; null without any.  Give only rows that it may learn from."""
    labelled = docs.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull())
    rows = labelled.count()
    if rows > max_rows:
        labelled = labelled.where(F.pmod(F.xxhash64(id_col), F.lit(1 << 20)) < int((1 << 20) * max_rows / rows))
    counted = written(word_counts(labelled, text_col, lang_col), "word-counts")
    langs = sorted(r[0] for r in counted.select("lang").distinct().collect())  # a row a language
    if not langs:
        return None
    size = vocabulary(vocabulary_path).size + 2
    model = Model(langs, np.tile((1e-4 * 0.5 ** (8 / vocabulary(vocabulary_path).lengths))[:, None], (1, len(langs))), vocabulary_path)  # long pieces first
    model.p[-1] = 0.0
    for _ in range(rounds):
        sent = docs.sparkSession.sparkContext.broadcast(model)

        def run(batches: Iterator[pa.RecordBatch], sent: Broadcast = sent) -> Iterator[pa.RecordBatch]:
            model = sent.value
            for batch in batches:
                lang, found, n = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_pylist(), batch.column(2).to_numpy()
                for i, name in enumerate(model.langs):
                    at = np.flatnonzero(lang == name)
                    uses = model.expected([found[k] for k in at.tolist()], n[at], i)
                    some = np.flatnonzero(uses)
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(some), pa.string()), pa.array(some.astype(np.int32)), pa.array(uses[some])], names=["lang", "piece", "uses"])

        p = np.full((size, len(langs)), smoothing)
        for r in counted.mapInArrow(run, "lang string, piece int, uses double").groupBy("lang", "piece").agg(F.sum("uses").alias("uses")).toLocalIterator():
            p[r.piece, langs.index(r.lang)] += r.uses
        p[-1] = 0.0
        model = Model(langs, p / p.sum(axis=0, keepdims=True), vocabulary_path)
    return model


class Scorer:
    """Scores texts by a model; keeps the scores of chunks that it has met."""

    def __init__(self, model: Model, most: int = CACHE) -> None:
        self.model, self.known, self.most = model, {}, most
        self.scores, self.counts, self.letters = np.zeros((1024, len(model.langs))), np.zeros(1024), np.zeros(1024)

    def learn(self, new: list[str]) -> None:
        first, end = len(self.known), len(self.known) + len(new)
        while end > len(self.counts):
            self.scores, self.counts, self.letters = (np.concatenate((x, np.zeros_like(x))) for x in (self.scores, self.counts, self.letters))
        found = [words(c) for c in new]
        of = np.repeat(np.arange(len(new)), list(map(len, found)))
        flat = {w: i for i, w in enumerate(dict.fromkeys(w for x in found for w in x))}
        at = np.fromiter((flat[w] for x in found for w in x), np.int64, len(of))
        each = self.model.scores(list(flat))[at] if flat else np.zeros((0, len(self.model.langs)))
        for k in range(len(self.model.langs)):
            self.scores[first:end, k] = np.bincount(of, each[:, k], len(new))
        self.counts[first:end] = np.bincount(of, minlength=len(new))
        self.letters[first:end] = np.bincount(of, np.fromiter((len(w) for x in found for w in x), float, len(of)), len(new))
        self.known.update(zip(new, range(first, end), strict=True))

    def judge(self, texts: pa.Array) -> Iterator[tuple[str, float, float]]:
        """(language, score, log-likelihood per letter and word mark) of each text."""
        for lot in (x for k in range(0, len(texts), 500) for x in lots(texts.slice(k, 500).to_pylist())):
            split = [text.split() if text else [] for text in lot]
            if len(self.known) > self.most:
                self.known = {}
            if new := list(set().union(*split).difference(self.known)):
                self.learn(new)
            for chunks in split:
                at = np.fromiter(map(self.known.__getitem__, chunks), np.int64, len(chunks))
                if not (total := self.counts[at].sum()):
                    yield "und", 0.0, -np.inf
                    continue
                sums = self.scores[at].sum(axis=0)
                best = int(np.argmax(sums))
                even = np.exp((sums - sums[best]) * (min(total, 20.0) / total))
                yield self.model.langs[best], float(1 / even.sum()), float(sums[best] / self.letters[at].sum())


def predict(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score): score is the language's share of the likelihoods of all, for the mean word raised to at most 20 words."""
    kept, sent = docs.select(id_col, text_col), docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(sent.value) if sent.value else None
        for batch in batches:
            found = list(scorer.judge(batch.column(1))) if scorer else [("und", 0.0, -np.inf)] * len(batch)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x for x, _, _ in found], pa.string()), pa.array([y for _, y, _ in found], pa.float64())], names=[id_col, "lang_pred", "score"])

    return kept.mapInArrow(run, f"`{id_col}` {kept.schema[id_col].dataType.simpleString()}, lang_pred string, score double")


def keep_known(docs: DataFrame, model: Model | None, least: float = 0.5, text_col: str = "text", fit: float = -np.inf) -> DataFrame:
    """``docs`` without those whose language is ``und``, scores under ``least``, or fits under ``fit``; all columns stay.

    The score compares the learned languages only, so a text in another one can reach 1.  The fit is absolute: the
    best language's log-likelihood per letter.  Without a model nothing can be judged and all documents stay.
    """
    if model is None:
        return docs
    where, sent = docs.columns.index(text_col), docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(sent.value, CACHE // 3)  # whole rows go along here, so less room is left for words
        for batch in slices(batches):
            yield batch.filter(pa.array([x != "und" and y >= least and z >= fit for x, y, z in scorer.judge(batch.column(where))], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
