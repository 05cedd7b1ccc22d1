"""URL rules as one bit-parallel wildcard automaton.

Every rule is a glob over the canonical URL "." + host + path: a leading "*"
that runs over host characters only, the rule's host, the rule's path and a
closing "*". All globs lie side by side in multiword Shift-And masks; one pass
over the characters moves the states of all of them at once, for a whole batch
of URLs in each vector step.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A rule: (allow or block, host, path).
Rule = tuple[str, str, str]

#: URLs moved together; their states take this many rows of mask words.
BLOCK = 4096


class GlobAutomaton:
    """Rules packed into Shift-And masks of 64-bit words.

    Rule r owns a run of bits: the leading "*" (alive until the first "/"), one
    bit for each literal byte, of which the last stays set once reached (the
    closing "*").
    """

    def __init__(self, rules: Sequence[Rule]):
        for verdict, host, path in rules:
            if verdict not in ("allow", "block") or "/" in host or not host or not path.startswith("/"):
                raise ValueError(f"not a rule: {verdict} {host}{path}")
        self.rules = [(v, h.lower() if h.isascii() else h, p) for v, h, p in rules]
        globs = [f".{h}{p}".encode() for _, h, p in self.rules]
        bits = sum(len(g) + 1 for g in globs)
        self.words = max(1, -(-bits // 64))
        self.step = np.zeros((256, self.words), np.uint64)  # bits that a byte may enter
        self.start = np.zeros(self.words, np.uint64)
        self.done, at = [], 0
        for g in globs:
            self._set(self.start, at)
            for k, byte in enumerate(g, 1):
                self._set(self.step[byte], at + k)
            self.done.append((((at + len(g)) // 64), np.uint64(1 << ((at + len(g)) % 64))))
            at += len(g) + 1
        self.hold = np.zeros(self.words, np.uint64)
        for word, bit in self.done:
            self.hold[word] |= bit
        # The longest rule wins: host and path together; then the longer host; then the first named.
        self.order = sorted(range(len(globs)), key=lambda r: (-len(globs[r]), -len(self.rules[r][1]), r))

    @staticmethod
    def _set(mask: np.ndarray, bit: int) -> None:
        mask[bit // 64] |= np.uint64(1 << (bit % 64))

    def match(self, urls: Sequence[bytes]) -> np.ndarray:
        """For each canonical URL the number of its winning rule, or -1."""
        out = np.full(len(urls), -1, np.int64)
        by_length = sorted(range(len(urls)), key=lambda i: -len(urls[i]))
        for lo in range(0, len(urls), BLOCK):
            part = by_length[lo : lo + BLOCK]  # longest first: finished URLs are a tail
            out[part] = self._block([urls[i] for i in part])
        return out

    def _block(self, urls: list[bytes]) -> np.ndarray:
        n, one, top = len(urls), np.uint64(1), np.uint64(63)
        flat = np.frombuffer(b"".join(urls), np.uint8)
        size = np.array([len(u) for u in urls])
        first = np.concatenate([[0], np.cumsum(size)[:-1]]).astype(np.int64)
        state = np.tile(self.start, (n, 1))
        in_host, alive = np.ones(n, bool), n
        for k in range(int(size[0]) if n else 0):
            while size[alive - 1] <= k:
                alive -= 1
            byte = flat[first[:alive] + k]
            s = state[:alive]
            moved = s << one
            if self.words > 1:
                moved[:, 1:] |= s[:, :-1] >> top
            moved &= self.step[byte]
            moved |= s & self.hold
            in_host[:alive] &= byte != 0x2F
            moved[in_host[:alive]] |= self.start  # the leading "*" lives on in the host
            state[:alive] = moved
        out = np.full(n, -1, np.int64)
        for r in self.order:
            word, bit = self.done[r]
            out[(out < 0) & ((state[:, word] & bit) != 0)] = r
        return out


@lru_cache(maxsize=4)
def automaton(rules: tuple[Rule, ...]) -> GlobAutomaton:
    return GlobAutomaton(rules)


def judge_urls(pages: DataFrame, rules: Sequence[Rule], default: str = "allow", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """Rows (`id_col`, host, path, rule, verdict), one for each row of `pages`; no shuffle.

    Host: after the first "://" up to "/", "?", "#" or the end, A-Z lower-cased.
    Path: from there up to "?", "#" or the end. Null urls and urls without "://"
    have both empty, no rule and the verdict `default`. A rule fits its host and
    all its subdomains where the path starts with the rule's; the longest wins
    (host and path together, then the longer host, then the first in `rules`).
    An empty path starts with no rule's path. Repeated rows and null ids are
    returned as they come; other columns are neither read nor returned. Urls of
    any length are read whole. `rules` are packed once in each worker: the masks
    take 256 x 8 bytes for each 64 bytes of rules.
    """
    fixed = tuple(map(tuple, rules))
    automaton(fixed)  # refuses wrong rules here, not on the executors
    after = F.when(F.instr(F.col(url_col), "://") > 0, F.expr(f"substring(`{url_col}`, instr(`{url_col}`, '://') + 3)")).otherwise("")
    rest = F.regexp_extract(F.coalesce(after, F.lit("")), r"(?s)\A([^?#]*)", 1)
    parts = pages.select(
        F.col(id_col),
        F.translate(F.regexp_extract(rest, r"(?s)\A([^/]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz").alias("host"),
        F.regexp_extract(rest, r"(?s)\A[^/]*(.*)", 1).alias("path"),
    )
    kind = pages.schema[id_col].dataType.simpleString()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = automaton(fixed)
        named = [*(h + p for _, h, p in a.rules), None]
        verdict = [*(v for v, _, _ in a.rules), default]
        for batch in batches:
            hosts, paths = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            won = a.match([f".{h}{p}".encode() for h, p in zip(hosts, paths, strict=True)])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([named[r] for r in won], pa.string()), pa.array([verdict[r] for r in won], pa.string())],
                names=[*batch.schema.names, "rule", "verdict"],
            )

    return parts.mapInArrow(rows, f"`{id_col}` {kind}, host string, path string, rule string, verdict string")
