"""Packing tokenised documents into fixed windows by best-fit decreasing.

Documents are tokenised once, in Spark tasks, into pieces: a document longer than the window is first cut into full
windows, and what is left of it is one shorter piece. Pieces' lengths are dealt evenly into groups of at most about GROUP
pieces, and each group is packed by itself: longest piece first, each into the open window with the
least room that still takes it, found in a segment tree over remaining capacities.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_characters, documents, stored, text_slices

#: Pieces packed together in one task. A group leaves at most a few windows partly empty.
GROUP = 65_536
#: Bytes of words and ids that a worker remembers, twice over, of words met again and of new ones.
REMEMBERED, REMEMBERED_NEW = 40 << 20, 12 << 20
#: Bytes of an entry besides its characters and ids.
ENTRY = 180
LONGEST_REMEMBERED = 64
#: Column of the pieces' numbers.
PIECE = "__piece"
#: Separators on which Python and the vocabulary's own white space disagree.
_ODD_SPACE = re.compile("[\x1c-\x1f]")
#: A stop or comma between a letter and white space: a pre-token of its own, as if it stood alone.
_STOP = re.compile("[.,](?<=[a-zß-öø-ÿ][.,])(?=[ \n])")
#: Pre-tokens of a lower-case ASCII word without an apostrophe.
_PARTS = re.compile("[a-z]+|[0-9]|[^a-z0-9]+")


class WordTokens(dict):
    """Ids of words, as little-endian uint32 bytes, for a lower-casing tokenizer that drops white space.

    Its splitting pattern never looks beyond white space, so a text's ids are those of its words one after another;
    words are given to the library when they are first met and remembered. A Latin word of letters alone is one
    pre-token, and a stop or comma after it another, so these go straight to the library's merges; so do the parts of
    an ASCII word. Latin-1 texts are lower-cased as wholes (character by character, as the vocabulary does it) and their
    stops parted from the words, so that a word is remembered once and not in each case and with each mark.

    Words met once wait in `new`, as most are not met again; those met twice are kept. Either memory is bounded: a full
    one becomes the older half, from which a word returns when it is met, and what was older goes.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.merge = self.tokenizer.model.tokenize
        self.special = [x.content for x in self.tokenizer.get_added_tokens_decoder().values()]
        self.bytes = byte_characters()
        self.older: dict[str, bytes] = {}
        self.new: dict[str, bytes] = {}
        self.older_new: dict[str, bytes] = {}
        self.held = self.held_new = 0

    def _encode(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def __missing__(self, word: str) -> bytes:
        made = self.older.get(word) or self.new.pop(word, None) or self.older_new.get(word)
        if made:
            self[word] = made
            self.held += len(word) + len(made) + ENTRY
            if self.held > REMEMBERED:
                self.older, self.held = dict(self), 0
                self.clear()
            return made
        made = self._ids(word)
        if len(word) <= LONGEST_REMEMBERED:
            self.new[word] = made
            self.held_new += len(word) + len(made) + ENTRY
            if self.held_new > REMEMBERED_NEW:
                self.new, self.older_new, self.held_new = {}, self.new, 0
        return made

    def _ids(self, word: str) -> bytes:
        lower = word.lower()
        if lower[-1] in ".," and len(word) > 1:
            return self[lower[:-1]] + self[lower[-1]] if _latin(lower[:-1]) else self._encode(word)
        if _latin(lower):
            return self._merged(lower if lower.isascii() else lower.encode().decode("latin-1").translate(self.bytes))
        if word.isascii() and "'" not in word:
            parts = _PARTS.findall(lower)
            return b"".join([self[x] for x in parts]) if len(parts) > 1 else self._merged(lower.translate(self.bytes))
        return self._encode(word)

    def _merged(self, part: str) -> bytes:
        return array("I", [x.id for x in self.merge(part)]).tobytes()

    def ids(self, text: str) -> bytes:
        if _ODD_SPACE.search(text) or any(x in text for x in self.special):
            return self._encode(text)
        if _latin_1(text):
            text = _STOP.sub(r" \g<0>", text.lower())
        return b"".join(map(self.__getitem__, text.split()))


def _latin(word: str) -> bool:
    return word.isalpha() and (word.isascii() or max(word) < "\u0250")


def _latin_1(text: str) -> bool:
    try:
        return text.isascii() or bool(text.encode("latin-1"))
    except UnicodeEncodeError:
        return False


_tokens: dict[str, WordTokens] = {}


def _word_tokens(path: str) -> WordTokens:
    """One for each worker process, so that remembered words serve its later tasks too."""
    if path not in _tokens:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _tokens[path] = WordTokens(path)
    return _tokens[path]


class BestFit:
    """Open windows by remaining room: a segment tree tells which rooms are present, leaves hold the windows."""

    def __init__(self, window: int):
        self.window = window
        self.leaves = 1 << window.bit_length()
        self.present = bytearray(2 * self.leaves)
        self.open: list[list[int]] = [[] for _ in range(window + 1)]
        self.made = 0

    def _mark(self, room: int, there: int) -> None:
        i, present = room + self.leaves, self.present
        present[i] = there
        while i > 1:
            i >>= 1
            now = present[2 * i] | present[2 * i + 1]
            if present[i] == now:
                break
            present[i] = now

    def _tightest(self, length: int) -> int:
        """The least present room of at least length, or -1."""
        i, present = length + self.leaves, self.present
        if present[i]:
            return length
        while i > 1:
            if not i & 1 and present[i + 1]:
                i += 1
                while i < self.leaves:
                    i = 2 * i + (not present[2 * i])
                return i - self.leaves
            i >>= 1
        return -1

    def place(self, length: int) -> tuple[int, int]:
        """(window, offset) for the next piece."""
        room = self._tightest(length)
        if room < 0:
            bin_, room = self.made, self.window
            self.made += 1
        else:
            bin_ = self.open[room].pop()
            if not self.open[room]:
                self._mark(room, 0)
        left = room - length
        if left:
            if not self.open[left]:
                self._mark(left, 1)
            self.open[left].append(bin_)
        return bin_, self.window - room


def tokenised_pieces(docs: DataFrame, tokenizer: str, window: int, end_id: int, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Full windows and the shorter rest of each document: key, start, length, doc_tokens, ids, and a number of each piece.

    Numbers are told apart by the task, so the table is to be stored before it is read twice.
    """
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        tokens = _word_tokens(tokenizer)
        number = TaskContext.get().partitionId() << 40
        for part in text_slices(batches, 1):
            row, start, length, total, ids = [], [], [], [], []
            for i, data in enumerate(part.column(1).to_pylist()):
                data = np.frombuffer(tokens.ids(data or "") + end, dtype="<u4").astype(np.int32)
                for at in range(0, len(data), window):
                    row.append(i)
                    start.append(at)
                    ids.append(data[at : at + window])
                    length.append(len(ids[-1]))
                    total.append(len(data))
            numbers = np.arange(number, number + len(row))
            number += len(row)
            columns = [part.column(0).take(pa.array(row, pa.int64())), *(pa.array(x, pa.int64()) for x in (start, length, total))]
            yield pa.record_batch([*columns, pa.array(ids, pa.list_(pa.int32())), pa.array(numbers, pa.int64())], names=[key, "start", "length", "doc_tokens", "ids", PIECE])

    schema = f"`{key}` {dict(docs.dtypes)[key]}, start long, length long, doc_tokens long, ids array<int>, {PIECE} long"
    return docs.select(key, F.col(text).cast("string")).mapInArrow(run, schema)


def pack(pieces: DataFrame, window: int) -> DataFrame:
    """Adds sequence_id and offset to rows of PIECE and a length from 1 to window; pieces is cheap to read twice."""
    n = pieces.count()
    groups = max(1, -(-n // GROUP))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        held = [b for b in batches if b.num_rows]
        if not held:
            return
        whole = pa.Table.from_batches(held)
        lengths = whole.column("length").to_numpy()
        order = np.lexsort((whole.column(PIECE).to_numpy(), -lengths))
        fit = BestFit(window)
        at = [fit.place(n) for n in lengths[order].tolist()]
        first = TaskContext.get().partitionId() << 32
        whole = whole.take(pa.array(order))
        whole = whole.append_column("sequence_id", pa.array([first + b for b, _ in at], pa.int64())).append_column("offset", pa.array([o for _, o in at], pa.int64()))
        yield from whole.combine_chunks().to_batches(max_chunksize=10_000)

    return pieces.repartition(groups).mapInArrow(run, f"{PIECE} long, length long, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer: str, window: int, end_id: int, text: str = "text", key: str = "doc_id", with_ids: bool = False) -> DataFrame:
    """Packs whole documents into sequences of at most window tokens, one row for each piece.

    Each document's ids are followed by end_id; null and empty texts are that id alone. Repeated rows, also with the
    same or a null key, are packed once each. Other columns are not read. An empty table gives no rows. Sequence ids
    are unique, not dense: the group in the upper and the window in the lower 32 bits. Within a group equal lengths
    keep the order of their pieces' numbers, so the packing is the same whenever a task runs again. Places are found
    from lengths alone and joined to the pieces; ids_crc32 is taken from the ids as they are placed.
    """
    pieces = stored(tokenised_pieces(docs, tokenizer, window, end_id, text, key), "pieces")
    places = stored(pack(pieces.select(PIECE, "length"), window).drop("length"), "places")
    names = [key, "start", "length", "ids_crc32", "doc_tokens"] + ["ids"] * with_ids + ["sequence_id", "offset"]

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("ids")
            flat, cut = ids.values.to_numpy().astype("<u4", copy=False), ids.offsets.to_numpy()
            crc = [zlib.crc32(flat[a:b]) for a, b in zip(cut, cut[1:], strict=False)]
            yield batch.append_column("ids_crc32", pa.array(crc, pa.int64())).select(names)

    # merged at every size: places grow with the documents, so they are never sent to all tasks
    placed = pieces.join(places.hint("merge"), PIECE).drop(PIECE)
    schema = f"`{key}` {dict(docs.dtypes)[key]}, start long, length long, ids_crc32 long, doc_tokens long" + ", ids array<int>" * with_ids + ", sequence_id long, offset long"
    return placed.mapInArrow(digest, schema)


def op2_packing(spark, sf_dir):
    import public_tokenizers

    return pack_documents(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"), window=4096, end_id=2)
