"""Language identification by segmentation-marginalised unigrams.

The vocabulary is fixed and public: all lower-case letter pieces of a sentencepiece model, of any
length, and every single letter of their alphabet (texts are lower-cased, so pieces with capitals can't
occur). Each language has a probability for each piece. The forward algorithm sums the probability of
*all* segmentations of a letter run, however long, into pieces; a text's score is the sum over the letter
runs of the whole text. The probabilities come from expectation-maximisation over all letter runs of a
bounded sample of labelled rows: about ``ROWS_PER_LANG`` a language, chosen by a 64-bit hash, alike at any
size. Training runs on the driver, on that sample.

Defined results: null text, or one without a letter (Unicode category L), gives ``und`` with score 0, and
so does every text when there is nothing to learn from; equal scores go to the language that sorts first;
repeated rows each get a row; rows without a language or text aren't learned from; an empty table gives an
empty result; other columns of the input are carried along unread, whatever their names. More than
``MOST_LANGS`` languages are refused, as the model has a column for each.
"""

from __future__ import annotations

import functools
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shoal.llm import scratch

VOCABULARY = public_tokenizers.path("piece_bpe_32k.model")
ROWS_PER_LANG, MOST_LANGS, ROUNDS = 1500, 2000, 3
UNKNOWN, LEAST, SPREAD, SHORT = "und", 0.5, 2.0, 10.0
_MARK, _SMOOTH, _UNSEEN = "▁", 0.05, 1e-9
_LETTERS = regex.compile(r"\p{L}+")
_CACHE, _SPAN, _SEGMENT, _USUAL = 200_000, 16, 4096, 64


def runs(chunk: str) -> list[str]:
    """Lower-cased runs of letters."""
    if chunk.isascii() and chunk.isalpha():
        return [chunk.lower()]
    return _LETTERS.findall(chunk.lower())


class Pieces:
    """The fixed vocabulary as a tree of characters; ``piece`` names the piece that ends in a node, or -1."""

    def __init__(self, path: str = VOCABULARY):
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        words = {sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))}
        words = {w for w in words if w == w.lower() and _LETTERS.fullmatch(w.removeprefix(_MARK) or "a")}
        words |= set("".join(words)) | {_MARK}
        self.path, self.words = path, sorted(words)
        if max(map(len, words)) > _SPAN:
            raise ValueError("a piece of the vocabulary is too long")
        use: dict[str, int] = {}
        node, self.piece, edges = {"": 0}, [-1], []
        for k, w in enumerate(self.words):
            for n in range(1, len(w) + 1):
                if w[:n] not in node:
                    node[w[:n]] = len(self.piece)
                    self.piece.append(-1)
                    edges.append((node[w[: n - 1]], w[n - 1], node[w[:n]]))
                    use[w[n - 1]] = use.get(w[n - 1], 0) + 1
            self.piece[node[w]] = k
        self.piece = np.array(self.piece, np.int32)
        letters = {c: k + 1 for k, c in enumerate(sorted(use, key=lambda c: (-use[c], c)))}  # 0: not in the alphabet
        self.code = np.zeros(0x110000, np.int16)
        for c, k in letters.items():
            self.code[ord(c)] = k
        self.next = np.full((len(self.piece), _USUAL), -1, np.int32)  # by the usual letters; the others are searched
        rare = []
        for a, c, b in edges:
            if letters[c] < _USUAL:
                self.next[a, letters[c]] = b
            else:
                rare.append((a << 16 | letters[c], b))
        self.rare_key, self.rare_next = (np.array(x, np.int64) for x in zip(*sorted(rare), strict=True))

    def codes(self, words: list[str]) -> np.ndarray:
        """[position, word] for words of one length, after the mark of a word's start."""
        points = np.frombuffer("".join([_MARK + w for w in words]).encode("utf-32-le"), dtype="<u4")
        return np.ascontiguousarray(self.code[points].reshape(len(words), -1).T)

    def _step(self, node: np.ndarray, c: np.ndarray) -> np.ndarray:
        to = self.next[node, np.where(c < _USUAL, c, 0)]
        rare = np.flatnonzero(c >= _USUAL)
        if len(rare):
            key = node[rare].astype(np.int64) << 16 | c[rare]
            at = np.minimum(np.searchsorted(self.rare_key, key), len(self.rare_key) - 1)
            to[rare] = np.where(self.rare_key[at] == key, self.rare_next[at], -1)
        return to

    def edges(self, code: np.ndarray, lo: int, hi: int) -> tuple[np.ndarray, ...]:
        """(end, size, word, piece) of all pieces that start at lo to hi - 1, by end and size. A letter off the alphabet is the piece
        after the last."""
        n, m = code.shape
        start, word = np.repeat(np.arange(lo, hi), m), np.tile(np.arange(m), hi - lo)
        node, out, size = np.zeros(len(start), np.int32), [], 0
        while len(start):
            to = self._step(node, code[start + size, word])
            size += 1
            ok = to >= 0
            if size == 1:
                odd = ~ok
                out.append((start[odd] + 1, np.ones(odd.sum(), np.int64), word[odd], np.full(odd.sum(), len(self.words), np.int32)))
            start, word, node = start[ok], word[ok], to[ok]
            piece = self.piece[node]
            hit = piece >= 0
            out.append((start[hit] + size, np.full(hit.sum(), size), word[hit], piece[hit]))
            more = start + size < n
            start, word, node = start[more], word[more], node[more]
        end, sizes, words, pieces = (np.concatenate([o[k] for o in out]) for k in range(4))
        order = np.argsort(end * (_SPAN + 1) + sizes, kind="stable")
        return end[order], sizes[order], words[order], pieces[order]


@functools.lru_cache(2)
def vocabulary(path: str) -> Pieces:
    return Pieces(path)


def _by_length(words: list[str]) -> dict[int, list[int]]:
    out: dict[int, list[int]] = {}
    for k, w in enumerate(words):
        out.setdefault(len(w), []).append(k)
    return out


def _split(edges: tuple[np.ndarray, ...]) -> list[tuple[int, int, np.ndarray, np.ndarray]]:
    """(end, size, words, pieces): each word at most once in an entry."""
    end, size, word, piece = edges
    cut = np.flatnonzero(np.diff(end * (_SPAN + 1) + size)) + 1
    first = np.concatenate([[0], cut]) if len(end) else cut
    return list(zip(end[first].tolist(), size[first].tolist(), np.split(word, cut), np.split(piece, cut), strict=False))


def forward(pieces: Pieces, code: np.ndarray, prob: np.ndarray, lattice: list | None = None):
    """Summed probabilities of all segmentations of the words in ``code``, a column a language.

    Positions lie in blocks of ``_SPAN``, each with a scale of its own, so no run is too long for doubles.
    Returns the logarithms at the end of the words; and, for a ``lattice`` of all edges, the values at all
    positions and the logarithm of each block's scale.
    """
    n, m = code.shape
    size = n + 1 if lattice else 2 * _SPAN
    a, scale, logs, back = np.zeros((size, m, prob.shape[1])), np.zeros((m, prob.shape[1])), [], None
    a[0] = 1.0
    logs.append(scale)
    at = 0
    for lo in range(0, n, n if lattice else _SEGMENT):
        hi = n if lattice else min(lo + _SEGMENT, n)
        for j, k, word, piece in lattice or _split(pieces.edges(code, max(0, lo - _SPAN + 1), hi)):
            if not lo < j <= hi:
                continue  # of an earlier segment, or left to the next one
            if j != at:
                at = j
                a[j % size] = 0.0
                if j % _SPAN == 0:
                    top = a[[i % size for i in range(j - _SPAN, j)]].max(axis=0)
                    back, scale = 1.0 / top, scale + np.log(top)
                    logs.append(scale)
            v = a[(j - k) % size][word] * prob[piece]
            a[j % size][word] += v * back[word] if (j - k) // _SPAN != j // _SPAN else v
    total = np.log(a[n % size]) + scale
    return (total, a, logs) if lattice else total


def _expected(pieces: Pieces, code: np.ndarray, lattice: list, prob: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """How often each piece is expected in words of these weights, over all their segmentations (one language)."""
    n, m = code.shape
    total, a, logs = forward(pieces, code, prob, lattice)
    b, at, scale, back = np.zeros((n + 1, m)), n // _SPAN, np.zeros(m), None
    b[n] = 1.0
    shift, factor = {at: scale}, {}
    share, used = [], []
    for j, k, word, piece in sorted(lattice, key=lambda e: e[1] - e[0]):
        i = j - k
        if i // _SPAN != at:  # all positions above are complete
            at = i // _SPAN
            top = b[i + 1 : i + 1 + _SPAN].max(axis=0)
            back, scale = 1.0 / top, scale + np.log(top)
            shift[at] = scale
        blocks = i // _SPAN, j // _SPAN
        if blocks not in factor:
            factor[blocks] = weight * np.exp(logs[blocks[0]][:, 0] + shift[blocks[1]] - total[:, 0])
        v = prob[piece, 0] * b[j][word]
        share.append(a[i, word, 0] * v * factor[blocks][word])
        used.append(piece)
        b[i][word] += v * back[word] if blocks[1] != at else v
    return np.bincount(np.concatenate(used), weights=np.concatenate(share), minlength=len(prob))


@dataclass
class Model:
    """Piece probabilities, a column a language; the last row is that of a letter off the alphabet. ``usual`` holds, for each
    language, the mean and the deviation of the log-probability of a letter of its own words."""

    langs: list[str]
    prob: np.ndarray
    path: str
    usual: np.ndarray

    def log_scores(self, words: list[str]) -> np.ndarray:
        pieces, out = vocabulary(self.path), np.empty((len(words), len(self.langs)))
        for n, at in _by_length(words).items():
            step = max(1, 50_000 // (n + 1))
            for k in range(0, len(at), step):
                out[at[k : k + step]] = forward(pieces, pieces.codes([words[i] for i in at[k : k + step]]), self.prob)
        return out


def train(counts: dict[str, dict[str, float]], path: str = VOCABULARY, rounds: int = ROUNDS) -> Model:
    """``counts``: language -> letter run -> weight. Expectation-maximisation over all segmentations."""
    pieces, langs = vocabulary(path), sorted(counts)
    rows = len(pieces.words)
    prior = 0.02 ** np.array([len(w) for w in pieces.words], float)  # longer pieces start rarer, as strings of letters are
    prob = np.vstack([np.repeat((prior / prior.sum())[:, None], len(langs), axis=1), np.full(len(langs), _UNSEEN)])
    usual = np.zeros((len(langs), 2))
    for x, lang in enumerate(langs):
        words = sorted(counts[lang])
        weight = np.array([counts[lang][w] for w in words])
        own = prob[:, x : x + 1].copy()
        codes = [(at[k : k + 20_000], pieces.codes([words[i] for i in at[k : k + 20_000]])) for at in _by_length(words).values() for k in range(0, len(at), 20_000)]
        groups = [(at, code, _split(pieces.edges(code, 0, len(code)))) for at, code in codes]
        for _ in range(rounds):
            total = sum((_expected(pieces, code, lattice, own, weight[at]) for at, code, lattice in groups), np.zeros(rows + 1))
            own[:rows, 0] = (total[:rows] + _SMOOTH) / (total[:rows] + _SMOOTH).sum()
        prob[:, x] = own[:, 0]
        found = Model([lang], own, path, usual[:1]).log_scores(words)[:, 0]
        letters = np.array([len(w) for w in words], float)
        mean = (weight * found).sum() / (weight * letters).sum()
        usual[x] = mean, np.sqrt((weight * (found - mean * letters) ** 2).sum() / (weight * letters).sum())
    return Model(langs, prob, path, usual)


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", path: str = VOCABULARY, rows_per_lang: int = ROWS_PER_LANG) -> Model:
    """Learn from the rows of ``docs`` whose language and text aren't null, from a bounded sample of each language."""
    rows = docs.select(F.col(lang_col).alias("_lang"), F.col(text_col).alias("_text"), (F.xxhash64(id_col, text_col).cast("double") / 2.0**64 + 0.5).alias("_h"))
    rows = rows.where("_lang is not null and _text is not null")
    sizes = rows.groupBy("_lang").agg(F.count(F.lit(1)).alias("_n")).limit(MOST_LANGS + 1).toArrow()
    if sizes.num_rows > MOST_LANGS:
        raise ValueError(f"more than {MOST_LANGS} languages")
    sizes = docs.sparkSession.createDataFrame(sizes, "_lang string, _n long")
    rows = rows.join(F.broadcast(sizes), "_lang").where(F.col("_h") * F.col("_n") < rows_per_lang).select("_lang", "_text")  # at most MOST_LANGS rows

    def count(batches):
        for b in batches:
            seen: dict[tuple, int] = {}
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for chunk in text.split():
                    seen[lang, chunk] = seen.get((lang, chunk), 0) + 1
            words: dict[tuple, int] = {}
            for (lang, chunk), n in seen.items():
                for r in runs(chunk):
                    words[lang, r] = words.get((lang, r), 0) + n
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in words], pa.string()), pa.array([k[1] for k in words], pa.string()), pa.array(list(words.values()), pa.int64())], ["lang", "word", "n"])

    words = rows.mapInArrow(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")).toArrow()  # of the bounded sample
    counts: dict[str, dict[str, float]] = {}
    for b in words.to_batches():
        for lang, word, n in zip(*(c.to_pylist() for c in b.columns), strict=True):
            counts.setdefault(lang, {})[word] = float(n)
    return train(counts, path)


class _Scorer:
    """Scores texts in a worker; what it has scored of the white-space-separated chunks is kept, up to a bound."""

    def __init__(self, model: Model):
        self.model, self.row = model, {}
        self.table = np.empty((1 << 16, len(model.langs) + 1))

    def _learn(self, chunks: set[str]) -> None:
        """Give each new chunk a row: its log score in each language, and how many letters it has."""
        new = [c for c in chunks if c not in self.row]
        if not new:
            return
        if len(self.row) + len(new) > _CACHE:
            self.row.clear()
            new = list(chunks)
        parts = [runs(c) for c in new]
        flat = [r for p in parts for r in p]
        words = dict.fromkeys(flat)
        score = self.model.log_scores(list(words))
        at = dict(zip(words, range(len(words)), strict=True))
        sizes = np.fromiter(map(len, parts), np.int64, len(parts))
        owner = np.repeat(np.arange(len(new)), sizes)
        rows = score[np.fromiter(map(at.__getitem__, flat), np.int64, len(flat))]
        base, end = len(self.row), len(self.row) + len(new)
        if end > len(self.table):
            self.table = np.vstack([self.table[:base], np.empty((max(end, 2 * base) - base, self.table.shape[1]))])
        for k in range(len(self.model.langs)):
            self.table[base:end, k] = np.bincount(owner, weights=rows[:, k], minlength=len(new))
        self.table[base:end, -1] = np.bincount(owner, weights=np.fromiter(map(len, flat), np.int64, len(flat)), minlength=len(new))
        self.row.update(zip(new, range(base, end), strict=True))

    def score(self, texts: list[str | None]) -> tuple[list[str], list[float], list[float]]:
        """Language, posterior, and by how many deviations (1 at least) of the language's own letters the text's probability a letter falls
        short of their mean, less what chance does to a text of so few letters."""
        langs = self.model.langs
        if not langs:
            return [UNKNOWN] * len(texts), [0.0] * len(texts), [0.0] * len(texts)
        pred, conf, short = [], [], []
        for group in scratch.bounded(texts, len, 1_000_000):
            split = [t.split() for t in group]
            self._learn(set().union(*split))
            ends = np.cumsum([0] + [len(x) for x in split])
            at = np.fromiter((k for x in split for k in map(self.row.__getitem__, x)), np.int64, ends[-1])
            filled = np.flatnonzero(np.diff(ends))
            sums = np.zeros((len(split), len(langs) + 1))
            if len(filled):
                sums[filled] = np.add.reduceat(self.table[at], ends[filled], axis=0)
            best = sums[:, :-1].argmax(axis=1)
            top = sums[np.arange(len(split)), best]
            posterior = 1.0 / np.exp(sums[:, :-1] - top[:, None]).sum(axis=1)
            letters = np.maximum(sums[:, -1], 1)
            mean, deviation = self.model.usual[best].T
            lacking = (mean - top / letters) / np.maximum(deviation, 1.0) - SHORT / np.sqrt(letters)
            none = sums[:, -1] == 0
            pred += [UNKNOWN if z else langs[k] for z, k in zip(none, best, strict=True)]
            conf += np.where(none, 0.0, posterior).tolist()
            short += np.where(none, 0.0, lacking).tolist()
        return pred, conf, short


def language_of(spark: SparkSession, model: Model, text: Column) -> Column:
    """A struct of a text's lang_pred, score (the posterior probability of that language, from 0 to 1) and lacking."""
    shared = spark.sparkContext.broadcast(model)  # vocabulary x at most MOST_LANGS numbers
    token = uuid.uuid4().hex

    @F.arrow_udf("struct<lang_pred: string, score: double, lacking: double>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scorer = scratch.held(("language", token), lambda: _Scorer(shared.value))
        for b in batches:
            pred, conf, short = scorer.score(b.to_pylist())
            yield pa.StructArray.from_arrays([pa.array(pred, pa.string()), pa.array(conf, pa.float64()), pa.array(short, pa.float64())], ["lang_pred", "score", "lacking"])

    return run.asNondeterministic()(text)  # so that it's evaluated once


def identify(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` without its text, plus lang_pred and score; columns of ``docs`` that have these names are replaced."""
    own = f"_{uuid.uuid4().hex}"
    found = docs.withColumn(own, language_of(docs.sparkSession, model, docs[text_col]))
    return found.withColumn("lang_pred", F.col(own)["lang_pred"]).withColumn("score", F.col(own)["score"]).drop(own, text_col)


def accept(docs: DataFrame, model: Model, least: float = LEAST, spread: float = SPREAD, text_col: str = "text") -> DataFrame:
    """``docs`` with unchanged columns, without texts that are ``und``, whose posterior is below ``least``, or whose
    probability a letter is further than ``spread`` deviations below what the language gives its own words."""
    own = f"_{uuid.uuid4().hex}"
    found = docs.withColumn(own, language_of(docs.sparkSession, model, docs[text_col]))
    sure = (F.col(own)["lang_pred"] != UNKNOWN) & (F.col(own)["score"] >= least) & (F.col(own)["lacking"] <= spread)
    return found.where(sure).drop(own)
