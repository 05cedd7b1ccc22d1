"""Token counts by heap-and-linked-list byte-pair merging.

A word's symbols are a doubly linked list; a heap holds the ranked adjacent
pairs. The lowest-ranked pair is popped and merged until none is left. The count
is the number of initial symbols minus the number of merges: no token ids are
made. Words repeat, so each Python worker keeps a bounded table of counts by word.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

#: Words whose counts a worker keeps; the table is emptied when it is full.
CACHE_WORDS = 300_000
#: Longer words are counted anew each time, so that the table's bytes are bounded too.
CACHE_CHARS = 64


def byte_symbols() -> list[str]:
    """The character that stands for each byte: itself if printable, else the next one from U+0100."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    out, spare = [], 0x100
    for b in range(256):
        if b in printable:
            out.append(chr(b))
        else:
            out.append(chr(spare))
            spare += 1
    return out


class PairMerger:
    """Counts the tokens of a word, or of a whole text, under a byte-pair vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        if model["type"] != "BPE" or model.get("unk_token") or model.get("dropout"):
            raise ValueError("a byte-pair vocabulary without unknown token or dropout is needed")
        ids, end = model["vocab"], model["end_of_word_suffix"]
        symbols = byte_symbols()
        self.inner = [ids[s] for s in symbols]
        self.final = [ids[s + end] for s in symbols]
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, (a, b) in enumerate(model["merges"]):
            self.merges.setdefault((ids[a], ids[b]), (rank, ids[a + b]))
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.pieces = regex.compile(split["pattern"]["Regex"])
        special = [t["content"] for t in spec["added_tokens"] if t["special"]]
        self.special = regex.compile("|".join(map(regex.escape, special)) or r"(?!)")
        self.by_word: dict[str, int] = {}

    def merged(self, data: bytes) -> int:
        """Tokens of one word's bytes."""
        n = len(data)
        if n < 2:
            return n
        merges, ids = self.merges, [self.inner[b] for b in data]
        ids[-1] = self.final[data[-1]]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(*m, i, ids[i], ids[i + 1]) for i in range(n - 1) if (m := merges.get((ids[i], ids[i + 1])))]
        # Entries order by rank, then by place: a rank fixes the merged symbol.
        heap = [(rank, i, new, a, b) for rank, new, i, a, b in heap]
        heapq.heapify(heap)
        left = n
        while heap:
            _, i, new, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue  # one of the pair was merged meanwhile
            ids[i], ids[j] = new, -1
            left -= 1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if m := merges.get((new, ids[k])):
                    heapq.heappush(heap, (m[0], i, m[1], new, ids[k]))
            if (h := before[i]) >= 0 and (m := merges.get((ids[h], new))):
                heapq.heappush(heap, (m[0], h, m[1], ids[h], new))
        return left

    def chunk(self, chunk: str) -> int:
        """Tokens of a stretch without white space."""
        total = 0
        parts = self.special.split(chunk) if "<|" in chunk else [chunk]
        total += len(parts) - 1  # each special string is one token
        for part in parts:
            # Letter by letter, as the vocabulary's normaliser does: no final sigma.
            part = unicodedata.normalize("NFC", part).replace("Σ", "σ").lower()
            for word in [part] if part.isalpha() and part.isascii() else self.pieces.findall(part):
                total += self.merged(word.encode())
        return total

    def count(self, text: str | None) -> int:
        """Tokens of a whole text; 0 for null or empty."""
        if not text:
            return 0
        if any(c in text for c in "\x1c\x1d\x1e\x1f"):  # white space to Python only
            chunks = regex.split(r"\s+", text)
        else:
            chunks = text.split()
        known, total = self.by_word, 0
        for w in chunks:
            n = known.get(w)
            if n is None:
                n = self.chunk(w)
                if len(w) <= CACHE_CHARS:
                    if len(known) >= CACHE_WORDS:
                        known.clear()
                    known[w] = n
            total += n
        return total


@lru_cache(maxsize=2)
def merger(name: str) -> PairMerger:
    """One merger per worker and vocabulary. `name`: a path, or a file of the installed public tokenizers."""
    if "/" not in name:
        import public_tokenizers

        name = public_tokenizers.path(name)
    return PairMerger(name)


def count_tokens(docs: DataFrame, vocabulary: str, limit: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (`id_col`, n_bytes, n_tokens, over_limit), one for each row of `docs`; no shuffle.

    Null or empty texts have 0 bytes and tokens; a null id stays null; repeated
    rows are returned as often as they come; an empty table gives no rows. Other
    columns of `docs` are neither read nor returned, so their names can't clash.
    Texts are counted whole however long they are; special strings inside a text
    are one token each.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = merger(vocabulary)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            n = [m.count(t) for t in texts]
            size = [len(t.encode()) if t else 0 for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(size, pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())],
                names=[id_col, "n_bytes", "n_tokens", "over_limit"],
            )

    return docs.select(id_col, text_col).mapInArrow(rows, f"`{id_col}` {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean")
