"""SentencePiece encoding and decoding of merge-type vocabularies by a score-ordered agenda.

A text, normalised as the vocabulary says, is a list of symbols, at first its
characters. The agenda holds the adjacent pairs that are pieces; the pair of the best
score, the leftmost of equals, is joined until none is left. Symbols that are no piece
fall back to their bytes. No piece goes on over a space that follows another
character, so texts are merged word by word, and each Python worker keeps a bounded
table of words. The agendas of all words that are new in an Arrow batch are worked off
side by side, a pair of each at a time; those of long words by a heap and a linked
list. What enters the table is encoded and decoded by the sentencepiece library too,
and must be equal.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import DataFrame

from lattica.llm.common import claim, pieces

#: The mark of a space in pieces.
SPACE = "▁"
#: Words that a worker keeps; the table is emptied when it is full.
CACHE_WORDS = 1_200_000
#: Longer words are encoded anew each time, so that the table's bytes are bounded too.
CACHE_CHARS = 64
#: Words whose agendas are worked off side by side, and the longest of them.
TOGETHER, SHORT = 8192, 32
#: Texts that are in the making at a time.
ROWS = 512
NEVER = np.iinfo(np.int32).max

# The library shows each byte that begins no character as one U+FFFD.
codecs.register_error("each_byte", lambda e: ("�" * (e.end - e.start), e.end))


class Disagreement(RuntimeError):
    """The agenda and the library gave different ids or texts."""


class _Symbols(dict):
    """A value for each piece; for a character that is none, that of its bytes, one after the other."""

    def __init__(self, agenda: Agenda, of, joined):
        super().__init__((i, of(i)) for i in range(agenda.n))
        self.agenda, self.of, self.joined = agenda, of, joined

    def __missing__(self, symbol: int):
        return self.joined.join([self.of(self.agenda.byte_id[b]) for b in chr(symbol - self.agenda.n).encode()])


class Agenda:
    """Encodes and decodes under a merge-type vocabulary with byte fallback."""

    def __init__(self, path: str):
        self.library = sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.n = n = sp.get_piece_size()
        kinds = ["control" if sp.is_control(i) else "unknown" if sp.is_unknown(i) else "byte" if sp.is_byte(i) else "unused" if sp.is_unused(i) else "" for i in range(n)]
        piece = [sp.id_to_piece(i) for i in range(n)]
        self.ids = {piece[i]: i for i in range(n) if not kinds[i]}
        in_bytes = {int(piece[i][3:5], 16): i for i in range(n) if kinds[i] == "byte"}
        if len(in_bytes) < 256 or "unused" in kinds:
            raise ValueError("a vocabulary with byte fallback and without unused pieces is needed")
        if any(SPACE in p.lstrip(SPACE) for p in self.ids) or not sp.normalize("x").startswith(SPACE):
            raise ValueError("a vocabulary is needed that puts a space before a text, and has pieces that hold spaces only at their begin")
        self.byte_id = [in_bytes[b] for b in range(256)]
        raw = [b"" if kinds[i] == "control" else piece[i].replace(SPACE, " ").encode() for i in range(n)]
        for b, i in in_bytes.items():
            raw[i] = bytes([b])
        self.spaced = {i for i in range(n) if not kinds[i] and piece[i].startswith(SPACE)}
        self.control = {i for i in range(n) if kinds[i] == "control"}
        self.shown, self.raw = _Symbols(self, str, ","), _Symbols(self, lambda i: raw[i], b"")
        # The agenda's order: the best score first.
        order = {s: r for r, s in enumerate(sorted({sp.get_score(i) for i in self.ids.values()}, reverse=True))}
        self.rank = {p: order[sp.get_score(i)] for p, i in self.ids.items() if len(p) > 1}
        pairs = sorted((self.symbol(p[:k]) << 32 | self.symbol(p[k:]), self.rank[p], self.ids[p]) for p in self.rank for k in range(1, len(p)) if (k == 1 or p[:k] in self.ids) and (k == len(p) - 1 or p[k:] in self.ids))
        self.pair, self.pair_rank, self.pair_id = (np.array(c, t) for c, t in zip(zip(*pairs, strict=True), (np.int64, np.int32, np.int32), strict=True))
        #: Words' ids in decimal, joined by commas; what they decode to, where that is not the word.
        self.words: dict[str, str] = {}
        self.others: dict[str, str] = {}
        self.cut = regex.compile(f"(?<=[^{SPACE}])(?={SPACE})")

    def symbol(self, s: str) -> int:
        """A piece's id; for a character that is none, a number beyond all ids."""
        i = self.ids.get(s)
        return self.n + ord(s) if i is None else i

    def _ranks(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and id of what each pair of symbols joins to; NEVER where it is no piece."""
        key = a.astype(np.int64) << 32 | b
        at = np.minimum(np.searchsorted(self.pair, key), len(self.pair) - 1)
        return np.where(self.pair[at] == key, self.pair_rank[at], NEVER), self.pair_id[at]

    def _side_by_side(self, words: list[str]) -> list[list[int]]:
        """The symbols that are left of each of some words of at most SHORT characters."""
        size = np.array([len(w) for w in words])
        width = int(size.max()) + 1
        flat = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        known, place = np.unique(flat, return_inverse=True)
        row = np.repeat(np.arange(len(words)), size)
        col = np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)
        symbols = np.full((len(words), width), -1, np.int64)
        symbols[row, col] = np.array([self.symbol(chr(c)) for c in known.tolist()])[place]
        rank, joined = self._ranks(symbols[:, :-1], symbols[:, 1:])
        after = np.broadcast_to(np.arange(1, width + 1), symbols.shape).copy()
        before = np.broadcast_to(np.arange(-1, width - 1), symbols.shape).copy()
        left = np.arange(len(words))
        while len(left):
            i = rank[left].argmin(axis=1)  # the leftmost of the best
            open_ = rank[left, i] != NEVER
            left, i = left[open_], i[open_]
            j = after[left, i]
            k = after[left, j]
            symbols[left, i], symbols[left, j] = joined[left, i], -1
            after[left, i], before[left, k] = k, i  # beyond its end a word has no symbol, but there is room for one
            rank[left, np.minimum(j, width - 2)] = NEVER
            rank[left, i], joined[left, i] = self._ranks(symbols[left, i], symbols[left, k])
            inner = before[left, i] >= 0
            at, i = left[inner], i[inner]
            h = before[at, i]
            rank[at, h], joined[at, h] = self._ranks(symbols[at, h], symbols[at, i])
        alive = symbols >= 0
        ends = np.cumsum(alive.sum(axis=1))
        out = symbols[alive].tolist()
        return [out[lo:hi] for lo, hi in zip([0, *ends.tolist()], ends.tolist(), strict=False)]

    def _by_heap(self, word: str) -> list[int]:
        """The same for one word of any length."""
        rank, n = self.rank, len(word)
        symbols: list[str] = list(word)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        agenda = [(r, i, 2) for i in range(n - 1) if (r := rank.get(word[i : i + 2])) is not None]
        heapq.heapify(agenda)
        while agenda:
            _, i, size = heapq.heappop(agenda)
            a, j = symbols[i], after[i]
            if not a or j >= n or len(a) + len(symbols[j]) != size:
                continue  # one of the pair was joined meanwhile; what lies at i only grows
            symbols[i] = a = a + symbols[j]
            symbols[j] = ""
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (r := rank.get(a + symbols[k])) is not None:
                    heapq.heappush(agenda, (r, i, size + len(symbols[k])))
            h = before[i]
            if h >= 0 and (r := rank.get(symbols[h] + a)) is not None:
                heapq.heappush(agenda, (r, h, len(symbols[h]) + size))
        return [self.symbol(s) for s in symbols if s]

    def merged(self, words: list[str]) -> list[list[int]]:
        """The symbols of each word: ids of pieces, and numbers beyond them for characters that are none."""
        out: list[list[int]] = [[]] * len(words)
        short = sorted((k for k, w in enumerate(words) if len(w) <= SHORT), key=lambda k: len(words[k]))
        for lo in range(0, len(short), TOGETHER):
            some = short[lo : lo + TOGETHER]
            for k, found in zip(some, self._side_by_side([words[k] for k in some]), strict=True):
                out[k] = found
        for k, w in enumerate(words):
            if len(w) > SHORT:
                out[k] = self._by_heap(w)
        return out

    def split(self, text: str) -> list[str]:
        """A text's words without the one space that comes before each."""
        text = self.library.normalize(text)
        if SPACE * 2 in text or text.endswith(SPACE):
            return [w[1:] for w in self.cut.split(text)] if text else []
        return text[1:].split(SPACE) if text else []

    def look_up(self, words: set[str]) -> tuple[dict[str, str], dict[str, str]]:
        """Shown ids of at least these words, and the texts of those that decode to others; those not kept yet are encoded and decoded, and checked against the library."""
        if len(self.words) > CACHE_WORDS:
            self.words, self.others = {}, {}
        new = list(words.difference(self.words))
        if not new:
            return self.words, self.others
        symbols = self.merged([SPACE + w for w in new])
        shown = [",".join([self.shown[s] for s in x]) for x in symbols]
        decoded = [b"".join([self.raw[s] for s in x]).decode()[1:] for x in symbols]
        self._check(new, shown, decoded)
        others = {w: d for w, d in zip(new, decoded, strict=True) if w != d}
        kept = {w: s for w, s in zip(new, shown, strict=True) if len(w) <= CACHE_CHARS}
        self.words.update(kept)
        self.others.update((w, d) for w, d in others.items() if w in kept)
        if len(kept) == len(new):
            return self.words, self.others
        return self.words | dict(zip(new, shown, strict=True)), self.others | others

    def _check(self, words: list[str], shown: list[str], decoded: list[str]) -> None:
        """Raises Disagreement unless the library gives the same for the words, written in a row."""
        plain = [k for k, w in enumerate(words) if w and SPACE not in w]
        spaced = [k for k, w in enumerate(words) if SPACE in w]  # spaces would run together, so each by itself
        for some in [plain[lo : lo + TOGETHER] for lo in range(0, len(plain), TOGETHER)] + [[k] for k in spaced]:
            # The library puts a space before a text and takes one off.
            ids = self.library.encode(" ".join([words[k].replace(SPACE, " ") for k in some]))
            mine = ",".join([shown[k] for k in some]), " ".join([decoded[k] for k in some])
            if mine != (",".join(map(str, ids)), self.library.decode(ids)):
                if some[1:]:
                    for k in some:
                        self._check([words[k]], [shown[k]], [decoded[k]])
                raise Disagreement(f"the agenda gives {mine[0][:80]} for {mine[1][:80]!r}, the library {ids[:20]}")

    def encode(self, text: str | None) -> list[int]:
        """A whole text's ids; none for null or empty."""
        words = self.split(text or "")
        found, _ = self.look_up(set(words))
        return [int(i) for w in words for i in found[w].split(",")]

    def decode(self, ids: list[int]) -> str:
        """The text of `ids`: control pieces vanish, bytes that are no text become U+FFFD each, a space that begins the first piece goes."""
        ids = [i for i in ids if i not in self.control]
        raw = b"".join([self.raw[i] for i in ids])
        return (raw[1:] if ids and ids[0] in self.spaced else raw).decode(errors="each_byte")

    def digests(self, texts: list[str | None]) -> Iterator[tuple[int, str, str]]:
        """For each text: the number of ids, the digest of the ids, the digest of what they decode to."""
        split = [self.split(t or "") for t in texts]
        shown, others = self.look_up(set().union(*split))
        for words in split:
            ids = ",".join(map(shown.__getitem__, words))
            decoded = " ".join([others.get(w, w) for w in words] if others else words)
            yield ids.count(",") + 1 if ids else 0, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()


@lru_cache(maxsize=2)
def agenda(name: str) -> Agenda:
    """One agenda per worker and vocabulary. `name`: a path, or a file of the installed public tokenizers."""
    claim("sentence_pieces", agenda.cache_clear)
    if "/" not in name:
        import public_tokenizers

        name = public_tokenizers.path(name)
    return Agenda(name)


def encode_texts(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (`id_col`, n_tokens, ids_sha256, decoded_sha256), one for each row of `docs`; no shuffle.

    Digests are lowercase hex: of the decimal ids joined by commas, and of the decoded
    text in UTF-8. Null or empty texts have no ids and the digests of nothing; a null
    id stays null; repeated rows are returned as often as they come; an empty table
    gives no rows. Other columns of `docs` are neither read nor returned, so their
    names can't clash. Texts are encoded whole however long they are; names of control
    pieces inside a text are plain text. A word about which the agenda and the library
    disagree raises.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = agenda(vocabulary)
        for batch in pieces(batches, ROWS):
            n, ids, decoded = zip(*a.digests(batch.column(1).to_pylist()), strict=True)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())], names=[id_col, "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(id_col, text_col).mapInArrow(rows, f"`{id_col}` {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
