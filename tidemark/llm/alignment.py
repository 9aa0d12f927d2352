"""Aligning two tokenisations of each text, and how often each pair of their tokens is linked in a corpus.

A text's ids by both vocabularies are laid side by side as byte ranges. Where a token of either side ends at the same
byte, a group ends. Shared ends after which both sides go on with a space-marked token are anchors: they cut a text
into windows of token ids, most of them words, and as a window's groups depend on its ids alone, they are worked out
once for each distinct pair of id tuples and remembered. Neither vocabulary looks across a single space between two
other characters, so a word met before is not tokenised again: its windows are known.

All links of a group's tokens count. How many documents hold a pair of ids is summed over the corpus; the counts of the
most frequent pairs, as many as a fixed bound allows, are sent to the documents, all others are joined to them.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_characters, documents, stored, text_slices

#: Bytes that a worker's memories of words and windows may hold, by an estimate; beyond it only what was met again stays.
REMEMBERED = 224 << 20
#: Estimated bytes of a remembered word and its window, besides twelve for each character.
ENTRY = 600
#: Pairs whose counts are sent to all tasks (17 bytes each).
MOST_SENT = 1 << 18
#: A pair of ids is a number: a * PAIR + b.
PAIR = 1 << 20
#: Parts the ids of the two sides of a window.
_BETWEEN = b"\xff\xff\xff\xff"
#: Numbers that align_texts gives for each text.
SIZES = ("n_a", "n_b", "n_groups", "n_links")
#: Cuts that no vocabulary's pattern looks across: a single space between two other characters.
_CUT = re.compile(r"(?<=\S) (?=\S)")


class Vocabulary:
    """Bytes, lengths and space marks of the tokens of one side."""

    def __init__(self, entries: list[bytes]):
        self.bytes = entries
        self.length = np.array([len(x) for x in entries], dtype=np.int64)
        self.marked = np.array([x[:1] == b" " for x in entries], dtype=bool)

    def spell(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids))


class ByteTokenizer(Vocabulary):
    """A byte-level BPE .json; strings of special tokens are plain text."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.merge = self.tokenizer.model.tokenize
        self.character = byte_characters()
        byte = {c: b for b, c in self.character.items()}
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        added = {x["id"]: x["content"].encode() for x in spec["added_tokens"]}
        entries = added | {i: bytes(map(byte.__getitem__, c)) for c, i in spec["model"]["vocab"].items() if i not in added}
        super().__init__([entries.get(i, b"") for i in range(max(entries) + 1)])
        self.ends = {x: [t.id for t in self.merge(x)] for x in ".,"}

    def _word(self, body: str) -> list[int] | None:
        """Ids of a space and a Latin word, which is one pre-token, or such a word and a stop or comma; None for others."""
        word = body[:-1] if body[-1:] in self.ends else body
        if not word.isalpha() or not (word.isascii() or max(word) < "\u0250"):
            return None
        spelled = f" {word}".encode().decode("latin-1").translate(self.character)
        return [t.id for t in self.merge(spelled)] + (self.ends[body[-1]] if len(word) < len(body) else [])

    def encode(self, bodies: list[str]) -> list[list[int]]:
        """Ids of a space and each body."""
        found = [self._word(x) for x in bodies]
        others = [i for i, x in enumerate(found) if x is None]
        for i, x in zip(others, self.tokenizer.encode_batch([f" {bodies[i]}" for i in others], add_special_tokens=False), strict=True):
            found[i] = x.ids
        return found


class PieceTokenizer(Vocabulary):
    """A sentencepiece model with byte fallback that puts a space before each text."""

    def __init__(self, path: str):
        import sentencepiece

        self.processor = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [self.processor.id_to_piece(i) for i in range(self.processor.get_piece_size())]
        if any("▁" in x.lstrip("▁") for x in names):
            raise ValueError("a piece goes on into the next word, so words can't be encoded one by one")
        is_byte = self.processor.is_byte
        super().__init__([bytes([int(x[3:5], 16)]) if is_byte(i) else x.replace("▁", " ").encode() for i, x in enumerate(names)])

    def encode(self, bodies: list[str]) -> list[list[int]]:
        return self.processor.encode(bodies, num_threads=1)


class Ragged:
    """Rows of numbers of different lengths that are appended, and gathered by row number."""

    def __init__(self, flat: np.ndarray | None = None, size: np.ndarray | None = None):
        self.flats, self.sizes = [np.zeros(0, np.int64) if flat is None else flat], [np.zeros(1, np.int64)] + ([] if size is None else [size])
        self.settle()

    def add(self, flat: np.ndarray, size: np.ndarray) -> None:
        self.flats.append(flat)
        self.sizes.append(size)

    def settle(self) -> None:
        """After rows were added, before any are gathered."""
        self.flat, size = np.concatenate(self.flats), np.concatenate(self.sizes)
        self.flats, self.sizes = [self.flat], [size]
        self.start = np.cumsum(size)

    def gather(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of the rows one after another, and the size of each row."""
        size = self.start[rows + 1] - self.start[rows]
        return self.flat[_spread(self.start[rows], size)], size


def _spread(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of as many places as size says, for each row."""
    return np.arange(int(size.sum())) + np.repeat(start - (np.cumsum(size) - size), size)


def _counted(group: np.ndarray, value: np.ndarray, times: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (group, value) in their order, and how often each occurs; values are below PAIR ** 2, groups below 2 ** 23."""
    both = group << 2 * PAIR.bit_length() - 2 | value
    order = np.argsort(both)
    both = both[order]
    first = np.nonzero(np.diff(both, prepend=-1))[0]
    n = np.diff(first, append=len(order)) if times is None else np.add.reduceat(times[order], first) if len(first) else times
    return both[first] >> 2 * PAIR.bit_length() - 2, both[first] & PAIR * PAIR - 1, n


def _flat(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    size = np.fromiter(map(len, lists), np.int64, len(lists))
    return np.fromiter(chain.from_iterable(lists), np.int64, int(size.sum())), size


class Aligner:
    """Both vocabularies and what a worker remembers: the groups of windows by their id tuples, and the windows of words."""

    def __init__(self, a: Vocabulary, b: Vocabulary):
        self.a, self.b = a, b
        #: words, and stretches of text with other white space at an end, to rows of windows; -1 for words that need neighbours
        self.words: dict[str, int] = {}
        self.stretches: dict[str, int] = {}
        self.rows = Ragged()
        self.bad = np.zeros(0, bool)
        #: ids of both sides to rows of pairs and times, texts, and counts of SIZES
        self.windows: dict[bytes, int] = {}
        self.pairs, self.times = Ragged(), Ragged()
        self.texts: list[str] = []
        self.counts = np.zeros((0, len(SIZES)), np.int64)
        self.word_hits, self.window_hits = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.held = 0

    def _forget(self) -> None:
        """Keeps the words that were met again and their windows, unless these are too many themselves."""
        words = [(w, i) for w, i in self.words.items() if i >= 0 and self.word_hits[i] > 1 and not self.bad[i]]
        if len(words) * ENTRY > REMEMBERED // 2:
            self.__init__(self.a, self.b)
            return
        number, size = self.rows.gather(np.array([i for _, i in words], np.int64))
        kept, number = np.unique(number, return_inverse=True)
        place = dict(zip(kept.tolist(), range(len(kept)), strict=True))
        self.words, self.stretches = {w: i for i, (w, _) in enumerate(words)}, {}
        self.rows, self.bad = Ragged(number.astype(np.int64), size), np.zeros(len(words), bool)
        self.windows = {k: place[i] for k, i in self.windows.items() if i in place}
        self.pairs, self.times = Ragged(*self.pairs.gather(kept)), Ragged(*self.times.gather(kept))
        self.texts, self.counts = [self.texts[i] for i in kept.tolist()], self.counts[kept]
        self.word_hits = np.zeros(len(words), np.int64)
        self.held = len(words) * ENTRY

    # windows ----------------------------------------------------------------------------------------------------------

    def _shared(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The places in a and in b of the tokens that end where a token of the other side ends."""
        end_a, end_b = np.cumsum(self.a.length[a]), np.cumsum(self.b.length[b])
        at = np.zeros(int(end_a[-1]) + 1, dtype=np.int8)
        at[end_a] = 1
        at[end_b] |= 2
        return np.nonzero(at[end_a] == 3)[0], np.nonzero(at[end_b] == 3)[0]

    def _remember(self, a: np.ndarray, na: np.ndarray, b: np.ndarray, nb: np.ndarray) -> None:
        """Works out the groups of windows: ids one after another, and the sizes of the windows."""
        n = len(na)
        ja, jb = self._shared(a, b)
        size_a, size_b = np.diff(ja, prepend=-1), np.diff(jb, prepend=-1)
        group = np.arange(len(ja))
        ga, gb = np.repeat(group, size_a), np.repeat(group, size_b)  # the group of each token
        window = np.searchsorted(np.cumsum(na), ja, side="right")  # of each group
        groups = np.bincount(window, minlength=n)
        links = np.add.reduceat(size_a * size_b, np.cumsum(groups) - groups)
        self.counts = np.concatenate([self.counts, np.stack([na, nb, groups, links], axis=1)])
        # distinct ids of a group's sides, then their products: a group of many equal tokens stays small
        xg, x, xn = _counted(ga, a)
        yg, y, yn = _counted(gb, b)
        many = np.bincount(yg, minlength=len(ja))
        own = many[xg]
        i, j = np.repeat(np.arange(len(x)), own), _spread((np.cumsum(many) - many)[xg], own)
        at, pair, times = _counted(window[xg][i], x[i] * PAIR + y[j], times=xn[i] * yn[j])
        size = np.bincount(at, minlength=n)
        self.pairs.add(pair, size)
        self.times.add(times, size)
        # texts: the ids of each group's sides, each behind its separator
        order = np.argsort(np.concatenate([2 * ga, 2 * gb + 1]), kind="stable")
        mark = np.zeros(len(order), np.int8)
        mark[ja + 1 - size_a] = 1
        mark[len(a) + jb + 1 - size_b] = 2
        parts = [",;|"[x] + str(y) for x, y in zip(mark[order].tolist(), np.concatenate([a, b])[order].tolist(), strict=True)]
        ends = np.cumsum(na + nb).tolist()
        self.texts += ["".join(parts[x:y])[1:] for x, y in zip([0, *ends], ends, strict=False)]

    def _window_numbers(self, a: np.ndarray, na: np.ndarray, b: np.ndarray, nb: np.ndarray) -> list[int]:
        """The remembered window of each pair of id tuples (ids one after another, and the sizes of the tuples)."""
        sa, sb = np.cumsum(na) - na, np.cumsum(nb) - nb
        whole_a, whole_b = a.astype("<i4").tobytes(), b.astype("<i4").tobytes()
        known, new, numbers = self.windows, [], []
        for i, (w, x, y, z) in enumerate(zip((4 * sa).tolist(), (4 * (sa + na)).tolist(), (4 * sb).tolist(), (4 * (sb + nb)).tolist(), strict=True)):
            k = whole_a[w:x] + _BETWEEN + whole_b[y:z]
            number = known.get(k)
            if number is None:
                number = known[k] = len(self.texts) + len(new)
                new.append(i)
            numbers.append(number)
        if new:
            new = np.array(new)
            self._remember(a[_spread(sa[new], na[new])], na[new], b[_spread(sb[new], nb[new])], nb[new])
        return numbers

    # full tokenisation ------------------------------------------------------------------------------------------------

    def _learn(self, bodies: list[str], into: dict[str, int]) -> None:
        """Tokenises words, checks that both sides spell them, and cuts their ids at anchors into windows."""
        if not bodies:
            return
        into.update(zip(bodies, range(len(self.bad), len(self.bad) + len(bodies)), strict=True))
        self.held += ENTRY * len(bodies) + 12 * sum(map(len, bodies))
        spelled = [b" " + x.encode() for x in bodies]
        sides, bad = [], np.zeros(len(bodies), dtype=bool)
        for side in (self.a, self.b):
            lists = side.encode(bodies)
            flat, n = _flat(lists)
            ends = np.concatenate([[0], np.cumsum(side.length[flat])])[np.cumsum(n)]
            if not (np.array_equal(ends, np.cumsum(np.fromiter(map(len, spelled), np.int64, len(spelled)))) and side.spell(flat.tolist()) == b"".join(spelled)):
                bad |= np.array([side.spell(x) != y for x, y in zip(lists, spelled, strict=True)])
            sides += [flat, n]
        a, na, b, nb = sides
        self.bad = np.append(self.bad, bad)
        if bad.any():
            a, b, na, nb = a[np.repeat(~bad, na)], b[np.repeat(~bad, nb)], na * ~bad, nb * ~bad
        if not len(a):
            self.rows.add(np.zeros(0, np.int64), na)
            return
        # every word begins with a space-marked token on both sides, so its own end is an anchor
        ja, jb = self._shared(a, b)
        anchor = self.a.marked[a[np.minimum(ja + 1, len(a) - 1)]] & self.b.marked[b[np.minimum(jb + 1, len(b) - 1)]]
        anchor[-1] = True
        ja, jb = ja[anchor] + 1, jb[anchor] + 1
        numbers = self._window_numbers(a, np.diff(ja, prepend=0), b, np.diff(jb, prepend=0))
        self.rows.add(np.array(numbers, np.int64), np.diff(np.searchsorted(ja, np.cumsum(na), side="right"), prepend=0))

    def _rows(self, texts: list[str]) -> list[list[int]]:
        """Rows of windows whose ids one after another are each text's."""
        cut = [x.split(" ") for x in texts]
        known = self.words
        new = list(dict.fromkeys(w for words in cut for w in words if w not in known))
        alone = [bool(w) and w.strip() == w for w in new]
        self._learn([w for w, x in zip(new, alone, strict=True) if x], known)
        known.update((w, -1) for w, x in zip(new, alone, strict=True) if not x)
        rows = [list(map(known.__getitem__, words)) for words in cut]
        whole = {i: _CUT.split(texts[i]) for i, r in enumerate(rows) if min(r) < 0}
        self._learn(list(dict.fromkeys(s for parts in whole.values() for s in parts if s not in self.stretches)), self.stretches)
        for i, parts in whole.items():
            rows[i] = list(map(self.stretches.__getitem__, parts))
        return rows

    def align(self, texts: list[str | None]) -> list[tuple]:
        """SIZES, groups_sha256, pairs and times of each text."""
        nothing = (0, 0, 0, 0, "", np.zeros(0, np.int64), np.zeros(0, np.int64))
        out = [nothing] * len(texts)
        if self.held > REMEMBERED:
            self._forget()
        some = [i for i, t in enumerate(texts) if t]
        if not some:
            return out
        words, n = _flat(self._rows([texts[i] for i in some]))
        if self.bad.any():
            good = np.bincount(np.repeat(np.arange(len(n)), n), self.bad[words], len(n)) == 0
            words, n, some = words[np.repeat(good, n)], n[good], [i for i, x in zip(some, good.tolist(), strict=True) if x]
            if not some:
                return out
        for x in (self.rows, self.pairs, self.times):
            x.settle()
        hits = np.bincount(words, minlength=len(self.bad))
        hits[: len(self.word_hits)] += self.word_hits
        self.word_hits = hits
        number, size = self.rows.gather(words)
        cuts = np.concatenate([[0], np.cumsum(size)])[np.concatenate([[0], np.cumsum(n)])]  # each text's windows
        sums = np.concatenate([np.zeros((1, len(SIZES)), np.int64), np.cumsum(self.counts[number], axis=0)])
        sizes = (sums[cuts[1:]] - sums[cuts[:-1]]).tolist()
        name, numbers, cuts = self.texts.__getitem__, number.tolist(), cuts.tolist()
        digest = [hashlib.sha256(";".join(map(name, numbers[x:y])).encode()).hexdigest() for x, y in zip(cuts, cuts[1:], strict=False)]
        # distinct windows of each text, then distinct pairs
        doc, number, n = _counted(np.repeat(np.arange(len(some)), np.diff(cuts)), number)
        pair, size = self.pairs.gather(number)
        doc, pair, times = _counted(np.repeat(doc, size), pair, times=self.times.gather(number)[0] * np.repeat(n, size))
        ends = np.searchsorted(doc, np.arange(len(some) + 1)).tolist()
        for k, i in enumerate(some):
            own = slice(ends[k], ends[k + 1])
            out[i] = (*sizes[k], digest[k], pair[own], times[own])
        return out


_aligners: dict[tuple[str, str], Aligner] = {}


def _aligner(a: str, b: str) -> Aligner:
    """One for each worker process, so that what it remembers serves its later tasks too."""
    if (a, b) not in _aligners:
        _aligners[a, b] = Aligner(ByteTokenizer(a), PieceTokenizer(b))
    return _aligners[a, b]


#: Column of the rows' numbers.
ROW = "__row"


def align_texts(docs: DataFrame, a: str, b: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Each row's alignment: key, the SIZES, groups_sha256, pairs (distinct linked pairs of ids, as a * PAIR + b), times (links of each) and ROW.

    a, b: the local paths, on every worker, of a byte-level BPE .json and a sentencepiece model. Rows are told apart by
    the task, so the table is to be stored before it is read twice.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        aligner = _aligner(a, b)
        number = TaskContext.get().partitionId() << 40
        for part in text_slices(batches, 1):
            n_a, n_b, groups, links, digest, pairs, times = zip(*aligner.align(part.column(1).to_pylist()), strict=True)
            row = np.arange(number, number + part.num_rows)
            number += part.num_rows
            lists = [pa.LargeListArray.from_arrays(np.cumsum([0, *map(len, x)]), pa.array(np.concatenate(x).astype(k))).cast(pa.list_(t)) for x, k, t in ((pairs, np.int64, pa.int64()), (times, np.int32, pa.int32()))]
            yield pa.record_batch([part.column(0), *(pa.array(x, pa.int64()) for x in (n_a, n_b, groups, links)), pa.array(digest, pa.string()), *lists, pa.array(row)], names=[key, *SIZES, "groups_sha256", "pairs", "times", ROW])

    schema = f"`{key}` {dict(docs.dtypes)[key]}, {', '.join(f'{c} long' for c in SIZES)}, groups_sha256 string, pairs array<long>, times array<int>, {ROW} long"
    return docs.select(key, F.col(text).cast("string")).mapInArrow(run, schema)


def pair_counts(aligned: DataFrame) -> DataFrame:
    """pair, n (documents that hold it linked) and best (is n the highest of its a?)."""
    counts = stored(aligned.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("n")), "pair-counts")
    a = F.shiftright("pair", PAIR.bit_length() - 1).alias("a")
    # a vocabulary bounds its rows, and partial aggregates do the work before they are dealt out
    highest = counts.select(a, "n").groupBy("a").agg(F.max("n").alias("highest"))
    return counts.withColumn("a", a).join(highest, "a").select("pair", "n", (F.col("n") == F.col("highest")).alias("best"))


def _most_frequent(counts: DataFrame, most: int) -> tuple[int, list]:
    """The least n from which on there are at most `most` pairs, and these pairs."""
    # eight steps for each doubling: a few hundred rows at any size
    step = F.floor(8 * F.log2("n"))
    steps = counts.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("pairs"), F.min("n").alias("least")).orderBy(F.desc("step")).collect()
    least, held = None, 0
    for s in steps:
        held += s.pairs
        if held > most:
            break
        least = s.least
    return (0, []) if least is None else (least, counts.where(F.col("n") >= least).collect())


def link_counts(aligned: DataFrame, most: int = MOST_SENT) -> DataFrame:
    """aligned, a stored table, with n_best and count_sum of each row instead of its pairs.

    Pairs of the highest counts, at most `most`, are sent to all tasks; rows are joined to the counts of the others, each
    of which fewer documents hold.
    """
    counts = stored(pair_counts(aligned), "pair-counts-best")
    least, frequent = _most_frequent(counts, most)
    frequent.sort(key=lambda r: r.pair)
    sent = aligned.sparkSession.sparkContext.broadcast((np.array([r.pair for r in frequent], np.int64), np.array([r.n for r in frequent], np.int64), np.array([r.best for r in frequent], np.int64)))

    def known(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """ROW, the sums over pairs that were sent, and the pairs that were not."""
        pairs, n, best = sent.value
        for part in batches:
            p, t = (part.column(c).flatten().to_numpy() for c in (1, 2))
            size = np.diff(part.column(1).offsets.to_numpy())
            row = np.repeat(np.arange(part.num_rows), size)
            at = np.minimum(np.searchsorted(pairs, p), max(0, len(pairs) - 1))
            there = pairs[at] == p if len(pairs) else np.zeros(len(p), dtype=bool)
            total = lambda x: np.bincount(row[there], (x[at[there]] * t[there]).astype(float), part.num_rows).astype(np.int64)
            rest = np.append(0, np.cumsum(np.bincount(row[~there], minlength=part.num_rows)))
            left = [pa.ListArray.from_arrays(pa.array(rest, pa.int32()), pa.array(x[~there])) for x in (p, t)]
            yield pa.record_batch([part.column(0), pa.array(total(best)), pa.array(total(n)), *left], names=[ROW, "n_best", "count_sum", "pairs", "times"])

    met = aligned.select(ROW, "pairs", "times").mapInArrow(known, f"{ROW} long, n_best long, count_sum long, pairs array<long>, times array<int>")
    sizes = aligned.drop("pairs", "times")
    if counts.where(F.col("n") < least).isEmpty() and least:
        return sizes.join(met.select(ROW, "n_best", "count_sum").hint("merge"), ROW)
    met = stored(met, "pairs-met")
    rest = met.select(ROW, F.explode(F.arrays_zip("pairs", "times")).alias("x")).select(ROW, "x.pairs", "x.times").withColumnRenamed("pairs", "pair")
    sums = rest.join(counts.where(F.col("n") < least) if least else counts, "pair").groupBy(ROW).agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("b"), F.sum(F.col("n") * F.col("times")).alias("s"))
    found = met.select(ROW, "n_best", "count_sum").join(sums, ROW, "left").select(ROW, (F.col("n_best") + F.coalesce("b", F.lit(0))).alias("n_best"), (F.col("count_sum") + F.coalesce("s", F.lit(0))).alias("count_sum"))
    return sizes.join(found, ROW)


def align_tokenizers(docs: DataFrame, a: str, b: str, text: str = "text", key: str = "doc_id", most: int = MOST_SENT) -> DataFrame:
    """key, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of each row.

    Null and empty texts, and those that either vocabulary does not spell byte by byte, have no tokens: zeros, and an
    empty groups_sha256. Every row counts as a document of its own, repeated ones and those with a null key too. Other
    columns are not read; names that clash with the result's don't matter. An empty table gives no rows.
    """
    aligned = stored(align_texts(docs, a, b, text, key), "aligned")
    return link_counts(aligned, most).select(key, *SIZES, "n_best", "count_sum", "groups_sha256")


def op11_tokenizer_alignment(spark, sf_dir):
    import public_tokenizers

    return align_tokenizers(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
