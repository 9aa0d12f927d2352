"""Exact byte-level BPE token counts by merging ragged symbol arrays rank by rank.

Texts are cut where the vocabulary's own splitting pattern cannot look across (a single space between two
non-space characters), so a chunk's count depends on nothing but the chunk. Chunks not met before are cut into
pre-tokens, and all of a batch's pre-tokens are merged together: one flat numpy array of symbols, one array of
row starts; in each round every row finds its lowest-rank pair and merges all of that pair's occurrences at once.
What is left in a row is its number of tokens.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, text_slices

#: Bytes of chunks and counts that a worker remembers; beyond it they become the older half, and what was older goes.
REMEMBERED = 16 << 20
#: Bytes of an entry besides its characters.
ENTRY = 150
#: Longer chunks are counted but not remembered.
LONGEST_REMEMBERED = 64
#: Characters of text whose chunks are held at once.
HELD_CHARS = 1_000_000
#: Marks a chunk that cannot be counted by itself, as it meets other white space at an end.
_ACROSS = 1 << 48
_NO_RANK = np.iinfo(np.int64).max


class BpeCounter:
    """Counts tokens as the `tokenizers` library gives them for a byte-level BPE file without normalizer."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        self.symbol = {c: i for c, i in vocab.items() if len(c) == 1}
        self.specials = [x["content"] for x in spec["added_tokens"]]
        self.size = max(vocab.values()) + 1
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        keys = np.array([vocab[a] * self.size + vocab[b] for a, b in merges], dtype=np.int64)
        made = np.array([vocab[a + b] for a, b in merges], dtype=np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.made = keys[order], order.astype(np.int64), made
        self.split = Tokenizer.from_file(path).pre_tokenizer.pre_tokenize_str
        self.known: dict[str, int] = {}
        self.older: dict[str, int] = {}
        self.held = 0

    def _pair_ranks(self, symbols: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Rank of (symbol, next symbol); none at the end of a row."""
        pair = symbols[:-1] * self.size + symbols[1:]
        at = np.minimum(np.searchsorted(self.keys, pair), len(self.keys) - 1)
        ranks = np.where(self.keys[at] == pair, self.ranks[at], _NO_RANK)
        return np.append(np.where(last[:-1], _NO_RANK, ranks), _NO_RANK)

    def merged_lengths(self, pre_tokens: list[str]) -> np.ndarray:
        """Symbols left in each pre-token (in the vocabulary's byte characters) after all merges."""
        sizes = np.fromiter(map(len, pre_tokens), np.int64, len(pre_tokens))
        result = sizes.copy()
        symbol = self.symbol
        flat = np.fromiter((symbol[c] for c in "".join(pre_tokens)), np.int64, int(sizes.sum()))
        rows = np.nonzero(sizes > 1)[0]
        flat = flat[np.repeat(sizes > 1, sizes)]
        sizes = sizes[rows]
        while len(rows):
            starts = np.cumsum(sizes) - sizes
            last = np.zeros(len(flat), dtype=bool)
            last[starts + sizes - 1] = True
            ranks = self._pair_ranks(flat, last)
            least = np.minimum.reduceat(ranks, starts)
            going = least != _NO_RANK
            if not going.all():
                result[rows[~going]] = sizes[~going]
                keep = np.repeat(going, sizes)
                flat, ranks = flat[keep], ranks[keep]
                rows, sizes, least = rows[going], sizes[going], least[going]
                if not len(rows):
                    break
                starts = np.cumsum(sizes) - sizes
            hit = ranks == np.repeat(least, sizes)
            # of touching occurrences (a pair of equal symbols in a run) every second one is taken, from the left
            at = np.nonzero(hit)[0]
            first = np.ones(len(at), dtype=bool)
            first[1:] = at[1:] != at[:-1] + 1
            run = np.maximum.accumulate(np.where(first, np.arange(len(at)), 0))
            at = at[(np.arange(len(at)) - run) % 2 == 0]
            flat[at] = self.made[ranks[at]]
            gone = np.zeros(len(flat), dtype=bool)
            gone[at + 1] = True
            sizes = sizes - np.add.reduceat(gone.astype(np.int64), starts)
            flat = flat[~gone]
        return result

    def _learn(self, chunks: set[str]) -> dict[str, int]:
        """Counts of chunks; _ACROSS for those that need their neighbours."""
        pieces: list[str] = []
        owner: list[tuple[str, int]] = []
        found: dict[str, int] = {}
        for chunk in chunks:
            body = chunk[1:] if chunk[:1] == " " else chunk
            if not body or body[0].isspace() or body[-1].isspace():
                found[chunk] = _ACROSS
                continue
            cut = self.split(chunk)
            pieces += [x for x, _ in cut]
            owner.append((chunk, len(cut)))
        if owner:
            each = self.merged_lengths(pieces)
            bounds = np.cumsum([0] + [n for _, n in owner][:-1])
            found.update(zip((c for c, _ in owner), np.add.reduceat(each, bounds).tolist(), strict=True))
        return found

    def _whole(self, text: str) -> int:
        """One text without any cutting at spaces."""
        pieces = [x for x, _ in self.split(text)]
        return int(self.merged_lengths(pieces).sum()) if pieces else 0

    def _plain(self, texts: list[str]) -> list[int]:
        """Counts of texts that hold no special token's string."""
        cut = []
        for text in texts:
            first, *rest = text.split(" ")
            cut.append([first, *map(" ".__add__, rest)] if text else [])
        missing = {c for chunks in cut for c in chunks if c not in self.known}
        again = {c: self.older[c] for c in missing if c in self.older}
        new = again | self._learn(missing - again.keys()) if missing else {}
        self.known.update(new)
        totals = [sum(map(self.known.__getitem__, chunks)) for chunks in cut]
        for c in [c for c in new if len(c) > LONGEST_REMEMBERED]:
            del self.known[c], new[c]
        self.held += sum(map(len, new)) + ENTRY * len(new)
        if self.held > REMEMBERED:
            self.known, self.older, self.held = {}, self.known, 0
        return [self._whole(t) if n >= _ACROSS else n for t, n in zip(texts, totals, strict=True)]

    def count(self, texts: list[str]) -> list[int]:
        """Tokens of each whole text."""
        out = [0] * len(texts)
        parts: list[str] = []
        owner: list[int] = []
        held = 0

        def flush() -> None:
            nonlocal parts, owner, held
            for i, n in zip(owner, self._plain(parts), strict=True):
                out[i] += n
            parts, owner, held = [], [], 0

        for i, text in enumerate(texts):
            pieces = [text]
            for special in self.specials:
                if special in text:
                    cut = [p.split(special) for p in pieces]
                    out[i] += sum(len(x) - 1 for x in cut)
                    pieces = [x for p in cut for x in p]
            parts += pieces
            owner += [i] * len(pieces)
            held += len(text)
            if held > HELD_CHARS:
                flush()
        flush()
        return out


_counters: dict[str, BpeCounter] = {}


def _counter(path: str) -> BpeCounter:
    """One counter for each worker process, so that what it has learned serves its later tasks too."""
    if path not in _counters:
        _counters[path] = BpeCounter(path)
    return _counters[path]


def count_tokens(docs: DataFrame, tokenizer: str, limit: int, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Token counts of whole texts, one row for each input row, without any shuffle.

    tokenizer: the local path of a byte-level BPE .json on every worker. Returns key, n_bytes, n_tokens and
    over_limit (n_tokens > limit). Null and empty texts have 0 bytes and 0 tokens; repeated rows and null keys each
    give a row; other columns are not read; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(tokenizer)
        for batch in text_slices(batches, 1):
            texts = [x or "" for x in batch.column(1).to_pylist()]
            n = counter.count(texts)
            size = [len(x.encode()) for x in texts]
            yield pa.record_batch(
                [batch.column(0), pa.array(size, pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())],
                names=[key, "n_bytes", "n_tokens", "over_limit"],
            )

    kind = dict(docs.dtypes)[key]
    return docs.select(key, F.col(text).cast("string")).mapInArrow(run, f"`{key}` {kind}, n_bytes long, n_tokens long, over_limit boolean")


def op3_token_counts(spark, sf_dir):
    import public_tokenizers

    return count_tokens(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), limit=1024)
