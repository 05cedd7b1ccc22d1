"""Language identification by segmentation-marginalised unigrams.

Each language has probabilities for the pieces of one fixed public vocabulary.
A word's likelihood is the sum over all its segmentations into pieces, which a
forward pass over the word's characters gives; a text's is the product over its
words. The piece probabilities come from expectation maximisation (forward and
backward) over word counts of a bounded sample of labelled rows.
"""

from __future__ import annotations

import hashlib
import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lattica.llm.common import claim, pieces

#: Sample bound: labelled rows of each language that training reads, in expectation.
MAX_DOCS_PER_LANG = 500
#: Sample bound: each language's most frequent words of those rows that training keeps.
MAX_WORDS_PER_LANG = 20_000
EM_ROUNDS = 3
#: Added to each piece's expected count.
SMOOTHING = 0.05
#: Words whose scores a worker keeps; the table is emptied when it is full.
CACHE_WORDS = 100_000
CACHE_CHARS = 64
#: Words up to this length are scored many at a time; no product of so many probabilities underflows.
TOGETHER_CHARS = 32
#: Words scored in one vector step, and characters of text whose words are gathered before that.
TOGETHER_WORDS, GATHERED_CHARS = 4096, 1_000_000
#: Forward values below this are scaled up; the scale is kept as a logarithm.
TINY = 1e-120
#: Starts a word, as in the vocabulary.
EDGE = "▁"
UNDETERMINED = "und"


def vocabulary_pieces(name: str) -> list[str]:
    """The text pieces of a sentencepiece file (a path, or a file of the installed public tokenizers)."""
    import sentencepiece

    if "/" not in name:
        import public_tokenizers

        name = public_tokenizers.path(name)
    m = sentencepiece.SentencePieceProcessor(model_file=name)
    return [m.id_to_piece(i) for i in range(m.get_piece_size()) if not (m.is_control(i) or m.is_unknown(i) or m.is_byte(i))]


@lru_cache(maxsize=2)
def piece_tree(name: str) -> dict:
    """The vocabulary as nested dicts by character; key 0 holds the piece's number."""
    root: dict = {}
    for k, piece in enumerate(vocabulary_pieces(name)):
        node = root
        for c in piece:
            node = node.setdefault(c, {})
        node[0] = k
    return root


def spans(word: str, tree: dict) -> list[list[tuple[int, int]]]:
    """For each place of `word`, (end, piece) of the pieces that start there; piece -1: a lone unknown character."""
    out, n = [], len(word)
    for i in range(n):
        node, found, j = tree, [], i
        while j < n and (node := node.get(word[j])) is not None:
            j += 1
            if (k := node.get(0)) is not None:
                found.append((j, k))
        if not found or found[0][0] != i + 1:
            found.append((i + 1, -1))
        out.append(found)
    return out


class PieceTable:
    """The vocabulary's tree as a hash table from (node, character) to node, for many words at a time."""

    def __init__(self, name: str):
        edges, pieces, todo = [], [], [piece_tree(name)]
        number = {id(todo[0]): 0}
        for node in todo:
            pieces.append(node.get(0, -1))
            for c, child in node.items():
                if c != 0:
                    number[id(child)] = len(todo)
                    edges.append((number[id(node)] << 21 | ord(c), len(todo)))
                    todo.append(child)
        self.piece = np.array(pieces, np.int64)
        self.bits = max(10, (4 * len(edges)).bit_length())
        self.keys, self.to = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, -1, np.int64)
        left = np.array(edges, np.int64).reshape(-1, 2)
        slot = self._slot(left[:, 0])
        while len(left):  # in turns: one edge of each slot, the rest one slot on
            free = self.keys[slot] < 0
            _, first = np.unique(np.where(free, slot, -1 - np.arange(len(slot))), return_index=True)
            won = np.zeros(len(slot), bool)
            won[first] = True
            won &= free
            self.keys[slot[won]], self.to[slot[won]] = left[won, 0], left[won, 1]
            left, slot = left[~won], (slot[~won] + 1) & ((1 << self.bits) - 1)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def step(self, node: np.ndarray, char: np.ndarray) -> np.ndarray:
        """The nodes one character on, -1 where there is none."""
        key = node << 21 | char
        slot = self._slot(key)
        held = self.keys[slot]
        out = np.where(held == key, self.to[slot], -1)
        open_ = np.flatnonzero((held != key) & (held >= 0))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & ((1 << self.bits) - 1)
            held = self.keys[slot[open_]]
            match = held == key[open_]
            out[open_[match]] = self.to[slot[open_[match]]]
            open_ = open_[~match & (held >= 0)]
        return out


@lru_cache(maxsize=2)
def piece_table(name: str) -> PieceTable:
    return PieceTable(name)


@dataclass(frozen=True)
class LanguageModel:
    """Piece probabilities by language; the last row stands for any unknown character."""

    vocabulary: str
    languages: tuple[str, ...]
    probability: np.ndarray  # (pieces + 1) x languages

    def word(self, word: str) -> list[float]:
        """Log-likelihoods of a word: the forward sum over all its segmentations."""
        word = EDGE + word
        known, tree, n = _rows(self), piece_tree(self.vocabulary), len(word)
        many = range(len(self.languages))
        alpha: list = [None] * (n + 1)
        alpha[0], scale = [1.0] * len(many), [0.0] * len(many)
        for i in range(n):
            a = alpha[i]
            if min(a) < TINY:  # rescale what is still ahead, language by language
                ahead = [x for x in alpha[i : i + 40] if x is not None]
                for k in many:
                    if 0 < (top := max(x[k] for x in ahead)) < TINY:
                        scale[k] += math.log(top)
                        for x in ahead:
                            x[k] /= top
            node, j = tree, i
            while j < n and (node := node.get(word[j])) is not None:
                j += 1
                if (piece := node.get(0)) is not None:
                    if (to := alpha[j]) is None:
                        alpha[j] = [x * y for x, y in zip(a, known[piece], strict=True)]
                    else:
                        alpha[j] = [z + x * y for x, y, z in zip(a, known[piece], to, strict=True)]
            if word[i] not in tree or 0 not in tree[word[i]]:
                unknown = [x * y for x, y in zip(a, known[-1], strict=True)]
                alpha[i + 1] = unknown if alpha[i + 1] is None else [x + y for x, y in zip(alpha[i + 1], unknown, strict=True)]
            alpha[i] = None
        return [(math.log(x) if x > 0 else -800.0) + s for x, s in zip(alpha[n], scale, strict=True)]


    def many(self, words: list[str]) -> np.ndarray:
        """`word` for each of `words`, of at most TOGETHER_CHARS characters: the same sums, in vector steps."""
        table, words = piece_table(self.vocabulary), [EDGE + w for w in words]
        length = np.array([len(w) for w in words])
        order = np.argsort(-length, kind="stable")
        length = length[order]
        m, n = len(words), int(length[0])
        flat = np.frombuffer("".join(words[k].ljust(n, "\0") for k in order.tolist()).encode("utf-32-le", "surrogatepass"), np.uint32)
        chars = np.ascontiguousarray(flat.reshape(m, n).astype(np.int64).T)
        alpha = np.zeros((n + 1, m, len(self.languages)))
        alpha[0] = 1.0
        for i in range(n):
            at = np.arange(int(np.searchsorted(-length, -i, "left")))  # words longer than i
            start, lone, j, node = alpha[i], np.ones(len(at), bool), i, np.zeros(len(at), np.int64)
            while len(at) and j < n:
                node = table.step(node, chars[j, at])
                on = node >= 0
                at, node, j = at[on], node[on], j + 1
                piece = table.piece[node]
                ends = piece >= 0
                to = at[ends]
                alpha[j, to] += start[to] * self.probability[piece[ends]]
                if j == i + 1:
                    lone[to] = False
            alone = np.flatnonzero(lone)
            alpha[i + 1, alone] += start[alone] * self.probability[-1]
        out = np.empty((m, len(self.languages)))
        out[order] = np.log(np.maximum(alpha[length, np.arange(m)], 1e-300))
        return out


_ROWS: dict[int, tuple[np.ndarray, list]] = {}


def _rows(model: LanguageModel) -> list[list[float]]:
    """The probabilities as lists, made once in each process for each model."""
    kept = _ROWS.get(id(model))
    if kept is None or kept[0] is not model.probability:
        _ROWS.clear()
        kept = _ROWS[id(model)] = (model.probability, model.probability.tolist())
    return kept[1]


def parts(word: str) -> list[str]:
    """A run in consecutive pieces of at most CACHE_CHARS characters; a space, which no run has, marks those that don't start it."""
    return [" " * (lo > 0) + word[lo : lo + CACHE_CHARS] for lo in range(0, len(word), CACHE_CHARS)]


def fit(counts: dict[str, dict[str, int]], vocabulary: str, rounds: int = EM_ROUNDS, smoothing: float = SMOOTHING) -> LanguageModel:
    """Expectation maximisation over word counts by language.

    All languages start from equal piece probabilities, discounted by length;
    each round sums a piece's posterior over every segmentation of every word. Longer
    runs, as of scripts without spaces, count by their `parts`.
    """
    languages = tuple(sorted(counts))
    tree, n_pieces = piece_tree(vocabulary), len(vocabulary_pieces(vocabulary))
    p = np.full((n_pieces + 1, max(1, len(languages))), 1.0 / (n_pieces + 1))
    for k, lang in enumerate(languages):
        words = [(w[1:] if w[0] == " " else EDGE + w, c) for run, c in counts[lang].items() for w in ([run] if run[:1] == " " else parts(run))]
        cut = [(spans(w, tree), c) for w, c in words]
        own = p[:, k].tolist()
        for _ in range(rounds):
            expected = [smoothing] * (n_pieces + 1)
            for edges, c in cut:
                n = len(edges)
                back = [0.0] * n + [1.0]
                for i in range(n - 1, -1, -1):
                    back[i] = sum(own[piece] * back[j] for j, piece in edges[i])
                if back[0] <= 0:
                    continue
                ahead = [1.0] + [0.0] * n
                ratio = c / back[0]
                for i in range(n):
                    if a := ahead[i]:
                        for j, piece in edges[i]:
                            x = a * own[piece]
                            ahead[j] += x
                            expected[piece] += ratio * x * back[j]
            total = sum(expected)
            own = [x / total for x in expected]
        p[:, k] = own
    return LanguageModel(vocabulary, languages, p)


def train(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", max_docs: int = MAX_DOCS_PER_LANG, max_words: int = MAX_WORDS_PER_LANG) -> LanguageModel:
    """Fits on rows of `docs` with a text and a language.

    Of each language, rows with the smallest hashes of their id are taken, about
    `max_docs` of them (all, if fewer), whole; of their words, longer ones cut into
    `parts`, the `max_words` most frequent. So what reaches the driver is bounded whatever the table's size.
    """
    rows = docs.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()).select(
        F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), (F.abs(F.xxhash64(F.col(id_col)) % 1_000_000) / 1e6).alias("draw")
    )
    share = {r["lang"]: max_docs / r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not share:
        return fit({}, vocabulary)
    keep = F.lit(False)
    for lang, s in share.items():
        keep = keep | ((F.col("lang") == lang) & (F.col("draw") < s))

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: dict[str, Counter] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found.setdefault(lang, Counter()).update(p for w in text.lower().split() for p in ((w,) if len(w) <= CACHE_CHARS else parts(w)))
            for lang, c in found.items():
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(c), pa.string()), pa.array(c.keys(), pa.string()), pa.array(c.values(), pa.int64())], names=["lang", "word", "n"])

    counted = rows.where(keep).select("lang", "text").mapInArrow(words, "lang string, word string, n bigint").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    # The sample's words only; of each language at most max_words rows leave.
    most = counted.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "word"))).where(F.col("r") <= max_words)
    counts: dict[str, dict[str, int]] = {}
    for r in most.select("lang", "word", "n").collect():
        counts.setdefault(r["lang"], {})[r["word"]] = r["n"]
    return fit(counts, vocabulary)


class Scorer:
    """Scores whole texts; keeps the scores of words it has met, up to a bound."""

    def __init__(self, model: LanguageModel):
        self.model = model
        self._forget()

    def _forget(self) -> None:
        self.number: dict[str, int] = {}
        self.table, self.used = np.zeros((1024, len(self.model.languages))), 0

    def _learn(self, words: list[str]) -> None:
        while self.used + len(words) > len(self.table):
            self.table = np.concatenate([self.table, np.zeros_like(self.table)])
        words.sort(key=len)
        for lo in range(0, len(words), TOGETHER_WORDS):
            part = words[lo : lo + TOGETHER_WORDS]
            scores = self.model.many(part) if len(part[-1]) < TOGETHER_CHARS else np.array([self.model.word(w) for w in part])
            self.table[self.used : self.used + len(part)] = scores
            self.number.update(zip(part, range(self.used, self.used + len(part)), strict=True))
            self.used += len(part)

    def texts(self, texts: list[str | None]) -> Iterator[tuple[str, float]]:
        """The likeliest language of each text and its posterior, all languages being equally likely before."""
        lo = 0
        while lo < len(texts):  # some texts at a time, so that their words fit
            hi, size = lo, 0
            while hi < len(texts) and size < GATHERED_CHARS:
                size += len(texts[hi] or "")
                hi += 1
            yield from self._some(texts[lo:hi])
            lo = hi

    def _some(self, texts: list[str | None]) -> Iterator[tuple[str, float]]:
        lang, split = self.model.languages, [t.lower().split() if t and any(map(str.isalpha, t)) else None for t in texts]
        if lang:
            met = set().union(*filter(None, split))
            short = {w for w in met if len(w) <= CACHE_CHARS}
            new = short - self.number.keys()
            if self.used + len(new) > CACHE_WORDS:
                self._forget()
                new = short
            some, more = [w for w in new if len(w) < TOGETHER_CHARS], [w for w in new if len(w) >= TOGETHER_CHARS]
            self._learn(some)
            self._learn(more)
        for words in split:
            if words is None or not lang:
                yield UNDETERMINED, 0.0
                continue
            known = self.number
            at = [known[w] for w in words if len(w) <= CACHE_CHARS] if any(len(w) > CACHE_CHARS for w in words) else list(map(known.__getitem__, words))
            total = self.table[at].sum(axis=0)
            if len(at) < len(words):
                total = total + sum(np.array(self.model.word(w)) for w in words if len(w) > CACHE_CHARS)
            best = int(total.argmax())
            yield lang[best], float(1 / np.exp(total - total[best]).sum())


_SCORERS: dict[bytes, Scorer] = {}


def _drop_tables() -> None:
    for kept in (_SCORERS, _ROWS):
        kept.clear()
    for made in (piece_tree, piece_table):
        made.cache_clear()


def scorer(model: LanguageModel) -> Scorer:
    """The process's scorer for a model, so that tasks share the words met."""
    claim("language", _drop_tables)
    name = hashlib.blake2b(model.probability.tobytes() + repr((model.vocabulary, model.languages)).encode()).digest()
    if name not in _SCORERS:
        _SCORERS.clear()
        _SCORERS[name] = Scorer(model)
    return _SCORERS[name]


def predict(docs: DataFrame, model: LanguageModel, text_col: str = "text", carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Rows (`carry`..., lang_pred, score), one for each row of `docs`; no shuffle.

    lang_pred is `und` and the score 0 where the text is null or has no letter, or
    where the model has no language; else one of the model's languages and its
    posterior in (0, 1]. Ties go to the first language by name. Texts are scored
    whole; repeated rows and null ids are returned as they come; columns other than
    `carry` are neither read nor returned.
    """
    spark = docs.sparkSession
    # languages x pieces doubles: bounded by the vocabulary file
    shared = spark.sparkContext.broadcast((model.vocabulary, model.languages, model.probability))
    fields = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in carry)
    carry_n = len(carry)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = scorer(LanguageModel(*shared.value))
        for batch in pieces(batches):
            got = list(own.texts(batch.column(carry_n).to_pylist()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:carry_n], pa.array([x for x, _ in got], pa.string()), pa.array([s for _, s in got], pa.float64())], names=[*carry, "lang_pred", "score"])

    return docs.select(*carry, text_col).mapInArrow(rows, f"{fields}, lang_pred string, score double")


def in_a_language(docs: DataFrame, model: LanguageModel, least_score: float, text_col: str = "text") -> DataFrame:
    """The rows of `docs` whose text is in one of the model's languages with at least `least_score`, with the columns of `docs`.

    Rejected: texts that are null or have no letter, and texts whose likeliest
    language has a lower posterior. No shuffle.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model.vocabulary, model.languages, model.probability))

    @F.pandas_udf("boolean")
    def known(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = scorer(LanguageModel(*shared.value))
        for texts in batches:
            got = own.texts(texts.tolist())
            yield pd.Series([lang != UNDETERMINED and score >= least_score for lang, score in got], dtype=bool)

    return docs.where(known(F.col(text_col)))
