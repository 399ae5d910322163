"""Sum-of-squares packing of tokenised documents into sequences of a fixed size.

A document's ids are cut into pieces of the capacity; the last piece may be
shorter.  A whole piece is a sequence by itself.  The others are items of integer
size: with N(g) the number of open sequences that have a gap of g left, each item
goes where the sum of the squares of N becomes smallest, be it an open sequence
that has room or a new one; at equal sums the tightest place is taken.  Items of a
packing group are placed from large to small, which the rule leaves free.

Pieces are written once.  Those that fill a sequence stay where they are; the others, one
a document at most, are dealt into packing groups of bounded expected size by a hash of the
piece and its place in the input, so that neither a key on many rows nor a long
document makes a large group.  Each group is packed by itself with memory for its own items and
one counter a gap.  A group leaves a few sequences unfilled, a share that its size
keeps small.

Tokenising goes word by word through a cache of bounded size in each worker, for a
tokenizer whose own steps drop white space and split as this module does; a text's ids
are then its words' ids in a row.  Any other tokenizer encodes each text as it is.

Edge cases: a null or empty text has the end id alone; a very long text is
tokenised in stretches; rows with equal keys are separate documents; an empty
table gives an empty result; extra columns are never touched.
"""

from __future__ import annotations

import json
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from . import base
from .base import any_key, read, remembered, ship, slices, stored

CAPACITY = 2048
#: Pieces that do not fill a sequence in a group, about.
GROUP_PIECES = 8192
#: Words and parts of words in a generation of a worker's cache.  A full generation becomes the old one, whose entries come back when asked for; the one before is forgotten.
MOST_WORDS, MOST_PARTS = 500_000, 300_000
_STRETCH = 1 << 20
#: The tokenizer's steps for which words may be looked up one by one.
_STEPS = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {"type": "Sequence", "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ]},
}
_WORD = re.compile(r"[^ \t-\r]+")
#: Words for which the tokenizer's own steps reduce to lower case and this split: printable ASCII and composed Latin-1 letters.
_PLAIN = re.compile("[!-~À-ÖØ-öø-ÿ]+")
_PART = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ]+")


def _byte_letters() -> dict[int, str]:
    """The letter by which a byte-level vocabulary writes each byte: printable ones themselves, the others from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(0x100 + i) for i, b in enumerate(rest)}


class WordIds(dict):
    """Little-endian unsigned 32-bit ids of a word, as bytes; computed when first asked for."""

    def __init__(self, path: str):
        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        own = json.loads(self.tokenizer.to_str())
        self.by_word = all(own[k] == v for k, v in _STEPS.items())
        self.old: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {}
        self.old_parts: dict[str, bytes] = {}
        letters = _byte_letters()
        self.letters = {chr(b): "".join(letters[x] for x in chr(b).encode()) for b in range(256)}

    def _part(self, part: str) -> bytes:
        found = self.parts.get(part)
        if found is None:
            if len(self.parts) >= MOST_PARTS:
                self.parts, self.old_parts = {}, self.parts
            found = self.old_parts.get(part)
            if found is None:
                written = "".join(map(self.letters.__getitem__, part))
                ids = [t.id for t in self.model.tokenize(written)]
                found = struct.pack(f"<{len(ids)}I", *ids)
            self.parts[part] = found
        return found

    def __missing__(self, word: str) -> bytes:
        if len(self) >= MOST_WORDS:
            self.old = dict(self)
            self.clear()
        ids = self.old.get(word)
        if ids is not None:
            pass
        elif _PLAIN.fullmatch(word) and len(word) < 200 and "<|" not in word:
            # Most words are letters alone, or with a mark at the end; they need no split.
            if word.isalpha():
                ids = self._part(word.lower())
            elif word[-1] in ",.!" and word[:-1].isalpha():
                ids = self._part(word[:-1].lower()) + self._part(word[-1])
            else:
                ids = b"".join(map(self._part, _PART.findall(word.lower())))
        else:
            ids = np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, "<u4").tobytes()
        self[word] = ids
        return ids

    def of(self, text: str) -> bytes:
        if not self.by_word:
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        if len(text) <= _STRETCH:
            return b"".join(map(self.__getitem__, _WORD.findall(text)))
        out, at = [], 0
        while at < len(text):
            to = at + _STRETCH
            while to < len(text) and text[to] not in " \t\n\x0b\f\r":
                to += 1
            out.append(b"".join(map(self.__getitem__, _WORD.findall(text, at, to))))
            at = to
        return b"".join(out)


def word_ids(path: str) -> WordIds:
    kept = remembered("word_ids")
    if path not in kept:
        kept[path] = WordIds(path)
    return kept[path]


@any_key("piece", "start", "length", "ids_crc32", "ids", "_place")
def pieces(docs: DataFrame, key: str, tokenizer: str, end_id: int = 0, capacity: int = CAPACITY, text: str = "text", with_ids: bool = False) -> DataFrame:
    """``(key, piece, start, length, ids_crc32[, ids])``: each document's ids, the end id last, cut into pieces of ``capacity``; and ``_place``, a number of the piece by which it is dealt."""
    key_type = docs.schema[key].dataType.simpleString()
    schema = f"`{key}` {key_type}, piece int, start bigint, length bigint, ids_crc32 bigint" + (", ids binary" if with_ids else "") + ", _place bigint"

    def cut_up(batches):
        from pyspark import TaskContext

        ids_of = word_ids(tokenizer)
        placed = TaskContext.get().partitionId() << 40
        end = np.array([end_id], "<u4").tobytes()
        for batch in slices(batches, text):
            rows: list[int] = []
            piece, start, length, crc, ids = [], [], [], [], []
            for i, value in enumerate(batch.column(text).to_pylist()):
                data = ids_of.of(value or "") + end
                n = len(data) // 4
                for k, at in enumerate(range(0, n, capacity)):
                    part = data[4 * at : 4 * (at + capacity)]
                    rows.append(i)
                    piece.append(k)
                    start.append(at)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
                    if with_ids:
                        ids.append(part)
            columns = [batch.column(key).take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))]
            names = [key, "piece", "start", "length", "ids_crc32"]
            if with_ids:
                columns, names = [*columns, pa.array(ids, pa.binary())], [*names, "ids"]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(placed + np.arange(len(rows)))], [*names, "_place"])
            placed += len(rows)

    ship(__name__, base.__name__)
    return docs.select(key, text).mapInArrow(cut_up, schema)


def place(sizes: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """Sequence number and offset of each item, placed in the given order."""
    count = np.zeros(capacity + 1, np.int64)
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    fill: list[int] = []
    where, offset = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    for i, s in enumerate(sizes.tolist()):
        gaps = s + np.flatnonzero(count[s:capacity])
        best_gap = 0
        rest = capacity - s
        best = 2 * count[rest] + 1 if rest else 0
        if len(gaps):
            # A gap of g loses one and one of g - s gains one, except that a gap of 0 counts for nothing.
            change = 2 - 2 * count[gaps] + 2 * count[gaps - s]
            if gaps[0] == s:
                change[0] = 1 - 2 * count[s]
            k = int(change.argmin())
            if change[k] <= best:
                best_gap = int(gaps[k])
        if best_gap:
            b = open_bins[best_gap].pop()
            count[best_gap] -= 1
            rest = best_gap - s
        else:
            b = len(fill)
            fill.append(0)
        where[i], offset[i] = b, fill[b]
        fill[b] += s
        if rest:
            open_bins[rest].append(b)
            count[rest] += 1
    return where, offset


def pack(cut_pieces: DataFrame, key: str, capacity: int = CAPACITY, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """``cut_pieces``, a written table, with ``sequence_id`` and ``offset``.

    A piece that fills a sequence is one, and stays where it is.  The others are dealt into groups of about ``group_pieces``.
    """
    full = F.col("length") == capacity
    rest = cut_pieces.filter(~full)
    n_groups = max(1, -(-rest.count() // group_pieces))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cut_pieces.schema if f.name != "_place")

    def pack_group(table: pa.Table) -> pa.Table:
        group = table.column("_group")[0].as_py()
        length, crc, placed = (table.column(c).to_numpy() for c in ("length", "ids_crc32", "_place"))
        table = table.drop_columns(["_group", "_place"]).combine_chunks()
        # The order depends on the pieces alone, not on how they arrived.
        order = np.lexsort((placed, crc, -length))
        where, offset = place(length[order], capacity)
        out = table.take(pa.array(order))
        return out.append_column("sequence_id", pa.array((group << 40) + where)).append_column("offset", pa.array(offset))

    ship(__name__, base.__name__)
    dealt = rest.withColumn("_group", F.pmod(F.xxhash64(F.lit(17), "ids_crc32", "_place"), F.lit(n_groups)).cast("long"))
    # Numbers of full sequences are negative, those of the others not.
    alone = cut_pieces.filter(full).withColumns({"sequence_id": -1 - F.col("_place"), "offset": F.lit(0).cast("long")}).drop("_place")
    return alone.unionByName(dealt.groupBy("_group").applyInArrow(pack_group, f"{schema}, sequence_id bigint, offset bigint"))


@any_key("piece", "start", "length", "ids_crc32", "ids", "sequence_id", "offset")
def pack_documents(docs: DataFrame, key: str = "doc_id", tokenizer: str | None = None, **options) -> DataFrame:
    """Pieces of all ``docs`` packed into as few sequences as the rule finds.  Pieces are written before they are dealt, so a task that runs again finds them as they were."""
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("word_bpe_49k.json")
    return pack(stored(pieces(docs, key, tokenizer, **options)), key, options.get("capacity", CAPACITY))


def op3_sos_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(read(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES = {"op3_sos_packing": op3_sos_packing}
ORACLES: dict[str, str] = {}
