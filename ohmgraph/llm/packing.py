"""Vector bin packing of tokenised examples into training sequences.

An example has three demands: tokens, one segment, loss-bearing tokens. A sequence has a limit for each. Long examples
first give whole sequences; what is left of each is placed by the dot-product heuristic: of the open sequences that can
hold it, the one whose free room points most in the direction of the example's demands takes it. Examples are placed in
batches of a bounded number of tokens, from large to small. Where cutting is allowed, the emptiest sequences of a batch
are then cut up to fill the others, and what the last one holds is dealt to sequences of power-of-two lengths, which
need no padding.

Each Spark task packs its own rows and keeps a batch at most, so no group grows with the data, nothing is shuffled, and
a repeated task gives the same sequences, numbered from its partition.

Defined results: a null text is empty and has the end id alone. Rows are packed one by one, so null or repeated doc_ids
are as good as others. A limit on segments that is already met leaves a sequence padded rather than overfull.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LENGTH = 2048
SEGMENTS = 64
BATCH = 1 << 20
#: Bytes of text that a task encodes together.
TEXT = 6 << 20
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, loss long"


#: The rules of a tokenizer whose texts may be encoded by pieces. It composes and lower-cases letters, drops white space
#: and joins nothing across the pieces that its split finds.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
END = "</w>"
#: Letters of ASCII words and words with composed Latin letters, for which those rules are plain; other words are encoded whole.
LETTERS = "a-z\u00df-\u00f6\u00f8-\u017f"
PLAIN = "^[\x21-\x7e\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u017f]+$"
PIECE = f"('s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[0-9]|[^0-9{LETTERS}]+)"


def gathered(flat: np.ndarray, start: np.ndarray, length: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs of flat at the asked places, one after another, and where each begins and the last ends."""
    n = length[at]
    cuts = np.concatenate([[0], np.cumsum(n)])
    return flat[np.repeat(start[at] - cuts[:-1], n) + np.arange(cuts[-1])], cuts


class Ids:
    """Ids of texts by a tokenizer file.

    If the file has the rules above, the distinct words of a batch of texts are cut into the pieces that its split
    finds, and each new piece is encoded once, many of them joined by blanks: an id whose entry carries the end mark
    closes a piece. Two generations of at most `most` pieces are remembered; those that recur move to the younger one.
    Words with other letters (whose case must stay, for a letter may compose with a mark in one case only) and texts with
    special tokens are encoded whole. By any other file, all texts are.
    """

    def __init__(self, path: str, most: int = 100_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a Spark task has one core, and each thread keeps memory
        from tokenizers import Tokenizer, pre_tokenizers

        self.whole, self.most = Tokenizer.from_file(path), most
        with open(path, encoding="utf-8") as f:
            rules = json.load(f)
        split = [p["pattern"] for p in (rules["pre_tokenizer"] or {}).get("pretokenizers", []) if p["type"] == "Split"]
        self.by_piece = rules["normalizer"] == NORMALIZER and split == [{"Regex": SPLIT}] and rules["model"].get("end_of_word_suffix") == END
        if self.by_piece:
            self.signs = "|".join(re.escape(t["content"]) for t in rules["added_tokens"]) or "$."
            self.pieces = Tokenizer(self.whole.model)
            self.pieces.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
            vocab = self.whole.get_vocab(with_added_tokens=True)
            self.closes = np.zeros(max(vocab.values()) + 1, bool)
            self.closes[[i for token, i in vocab.items() if token.endswith(END)]] = True
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def forget(self) -> None:
        """Gives back what a task has learnt."""
        self.known, self.older = {}, {}
        pa.default_memory_pool().release_unused()

    def encoded(self, texts: list[str]) -> list[bytes]:
        found = self.whole.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, "<u4").tobytes() for e in found]

    def joined(self, new: list[str], run: int = 512) -> Iterator[tuple[str, bytes]]:
        found = self.pieces.encode_batch_fast([" ".join(new[k : k + run]) for k in range(0, len(new), run)], add_special_tokens=False)
        for k, e in enumerate(found):
            ids, own = np.array(e.ids, "<u4"), new[k * run : (k + 1) * run]
            ends = (4 * (np.flatnonzero(self.closes[ids]) + 1)).tolist()
            raw = ids.tobytes()
            yield from zip(own, map(raw.__getitem__, map(slice, [0, *ends], ends)), strict=True)

    def table(self, keys: list[str], encode: Callable) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The ids of all keys, and where each key's begin and how many they are."""
        known, older = self.known, self.older
        known[""] = b""  # stands at both ends of what is split
        new = [k for k in keys if k not in known]
        if older:
            known.update((k, older[k]) for k in new if k in older)
            new = [k for k in new if k not in known]
        if new:
            known.update(encode(new))
        ids = list(map(known.__getitem__, keys))
        length = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        return np.frombuffer(b"".join(ids), "<u4"), np.cumsum(length) - length, length

    def encode(self, texts: pa.Array) -> list[bytes]:
        """Each text's ids as little-endian unsigned 32-bit numbers."""
        texts = texts.cast(pa.string()).fill_null("")
        if not self.by_piece:
            return self.encoded(texts.to_pylist())
        special = pc.match_substring_regex(texts, self.signs)
        words = pc.ascii_split_whitespace(pc.if_else(special, "", texts))
        coded = words.flatten().dictionary_encode()
        plain = pc.match_substring_regex(coded.dictionary, PLAIN)
        cut = pc.ascii_split_whitespace(pc.replace_substring_regex(pc.utf8_lower(coded.dictionary.filter(plain)), PIECE, r"\1 "))
        parts = cut.flatten().dictionary_encode()
        flat, ends = gathered(*self.table(parts.dictionary.to_pylist(), self.joined), parts.indices.to_numpy())
        others = coded.dictionary.filter(pc.invert(plain)).to_pylist()
        more, start, length = self.table(others, lambda new: zip(new, self.encoded(new), strict=True))
        # where each distinct word's ids begin, and how many they are
        own, rest = np.flatnonzero(plain.to_numpy(zero_copy_only=False)), np.flatnonzero(~plain.to_numpy(zero_copy_only=False))
        first, n = np.zeros(len(plain), np.int64), np.zeros(len(plain), np.int64)
        at = ends[cut.offsets.to_numpy()]
        first[own], n[own] = at[:-1], np.diff(at)
        first[rest], n[rest] = start + len(flat), length
        ids, cuts = gathered(np.concatenate([flat, more]), first, n, coded.indices.to_numpy())
        raw, at = ids.tobytes(), (4 * cuts[words.offsets.to_numpy()]).tolist()
        out = [raw[a:b] for a, b in zip(at, at[1:], strict=False)]
        for i in np.flatnonzero(special.to_numpy(zero_copy_only=False)).tolist():
            out[i] = self.encoded([texts[i].as_py()])[0]
        if len(self.known) > self.most:
            self.known, self.older = {}, self.known
        return out


@dataclass
class Piece:
    example: int
    start: int
    length: int
    loss: int


@dataclass
class Bin:
    pieces: list[Piece] = field(default_factory=list)

    @property
    def used(self) -> int:
        return sum(p.length for p in self.pieces)


def place(pieces: list[Piece], limits: tuple[int, int, int]) -> list[Bin]:
    """Dot-product placement, largest first; limits: tokens, segments, loss-bearing tokens."""
    cap = np.array(limits, float)
    bins: list[Bin] = []
    room = np.empty((max(1, len(pieces)), 3))  # free share of each limit, of open bins
    open_: list[int] = []
    for p in sorted(pieces, key=lambda p: (-p.length, p.example, p.start)):
        need = np.array([p.length, 1, p.loss]) / cap
        free = room[: len(open_)]
        fits = (free >= need - 1e-12).all(1)
        if fits.any():
            # normalised, the product prefers a direction; ties go to the fuller bin, then to the older
            score = np.where(fits, (free @ need) / (np.sqrt((free * free).sum(1)) + 1e-9), -1.0)
            k = int(np.lexsort((free[:, 0], -np.round(score, 9)))[0])
        else:
            k = len(open_)
            open_.append(len(bins))
            bins.append(Bin())
            room[k] = 1.0
        bins[open_[k]].pieces.append(p)
        room[k] -= need
        if (room[k] * cap < 0.5).any():  # full in some respect: closed
            last = len(open_) - 1
            room[k], open_[k] = room[last], open_[last]
            open_.pop()
    return bins


def fill(bins: list[Bin], limits: tuple[int, int, int]) -> list[Bin]:
    """Cuts up the emptiest bins to fill the others' room; the last remains go to bins of power-of-two lengths."""
    tokens, segments, losses = limits
    bins = sorted(bins, key=lambda b: (-b.used, b.pieces[0].example))
    used = [b.used for b in bins]
    i, j = 0, len(bins) - 1
    while i < j:
        if used[i] >= tokens or len(bins[i].pieces) >= segments:
            i += 1
            continue
        p = bins[j].pieces[-1]
        n = min(tokens - used[i], p.length)
        whole = n == p.length
        loss = p.loss if whole else max(0, p.loss - (p.length - n))  # loss-bearing tokens come last in an example
        if sum(q.loss for q in bins[i].pieces) + loss > losses:
            i += 1
            continue
        bins[i].pieces.append(Piece(p.example, p.start + p.length - n, n, loss))
        used[i] += n
        used[j] -= n
        bins[j].pieces.pop()
        if not whole:
            bins[j].pieces.append(Piece(p.example, p.start, p.length - n, p.loss - loss))
        elif not bins[j].pieces:
            j -= 1
    out = []
    for b in bins[: j + 1]:
        out += [b] if b.used == tokens else powers(b)
    return out


def powers(b: Bin) -> list[Bin]:
    """A bin's pieces, cut into bins whose lengths are powers of two."""
    out, left, queue = [], b.used, list(b.pieces)
    while left:
        size = 1 << (left.bit_length() - 1)
        left -= size
        out.append(Bin())
        while size:
            p = queue.pop(0)
            n = min(size, p.length)
            tail = min(p.loss, p.length - n)
            out[-1].pieces.append(Piece(p.example, p.start, n, p.loss - tail))
            if n < p.length:
                queue.insert(0, Piece(p.example, p.start + n, p.length - n, tail))
            size -= n
    return out


def slices(example: int, n: int, loss: int, limits: tuple[int, int, int]) -> list[Piece]:
    """An example from its start in pieces of whole sequences, as far as it exceeds one in tokens or in loss-bearing tokens, and the rest."""
    tokens, _, losses = limits
    out, at, silent = [], 0, n - loss  # loss-bearing tokens come last in an example
    while n - at > tokens or loss > losses:
        size = min(tokens, max(0, silent - at) + losses)
        share = max(0, at + size - max(at, silent))
        out.append(Piece(example, at, size, share))
        at, loss = at + size, loss - share
    return [*out, Piece(example, at, n - at, loss)] if n > at else out


def pack_batch(lengths: list[int], losses: list[int], limits: tuple[int, int, int], cut: bool) -> list[Bin]:
    """Bins for examples that each may be longer than a bin; cut: whether room may be filled by cutting examples that fit one."""
    full, rest = [], []
    for e, (n, loss) in enumerate(zip(lengths, losses, strict=True)):
        for p in slices(e, n, loss, limits):
            if p.length == limits[0]:
                full.append(Bin([p]))
            else:
                rest.append(p)
    placed = place(rest, limits)
    return full + (fill(placed, limits) if cut else placed)


def runs(column: pa.Array, most: int = TEXT) -> Iterator[tuple[int, int]]:
    """Cuts of a column of texts into runs of some bytes; a longer text is a run of its own."""
    size = pc.fill_null(pc.binary_length(column), 0).to_numpy()
    at = held = 0
    for i, n in enumerate(size.tolist()):
        if held and held + n > most:
            yield at, i
            at, held = i, 0
        held += n
    if at < len(column):
        yield at, len(column)


def pack(examples: DataFrame, tokenizer: str, end_id: int = 1, length: int = LENGTH, segments: int = SEGMENTS, loss_tokens: int | None = None, cut: bool = True, batch: int = BATCH, id_col: str = "doc_id", text_col: str = "text", loss_col: str | None = None) -> DataFrame:
    """Packs each row's text, and end_id after it: a row a piece.

    doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, loss. length, segments and loss_tokens (length by
    default) limit a sequence; batch: tokens that a task packs together; loss_col: how many of an example's last tokens,
    the end among them, bear loss (all by default and where it is null).
    """
    limits = (length, segments, loss_tokens or length)
    end = np.array([end_id], "<u4").tobytes()
    names = [x.split()[0] for x in PIECES.split(", ")]

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = tokenizer_of(tokenizer)
        number = TaskContext.get().partitionId() << 33
        held: list[tuple[int | None, bytes, int | None]] = []

        def flush() -> pa.RecordBatch:
            nonlocal number
            lengths = [len(ids) // 4 for _, ids, _ in held]
            losses = [n if x is None else min(max(x, 0), n) for n, (_, _, x) in zip(lengths, held, strict=True)]
            rows = []
            for b in pack_batch(lengths, losses, limits, cut):
                at = 0
                for p in b.pieces:
                    name, ids, _ = held[p.example]
                    crc = zlib.crc32(ids[4 * p.start : 4 * (p.start + p.length)])
                    rows.append((name, p.start, p.length, crc, lengths[p.example], number, at, p.loss))
                    at += p.length
                number += 1
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows, strict=True)], names)

        try:
            tokens = 0
            for frame in frames:
                texts = frame.column("text")
                for a, b in runs(texts):
                    part = frame.slice(a, b - a)
                    losses = part.column("loss").to_pylist()
                    for name, ids, loss in zip(part.column("doc_id").to_pylist(), known.encode(part.column("text")), losses, strict=True):
                        held.append((name, ids + end, loss))
                        tokens += len(ids) // 4 + 1
                        if tokens >= batch:
                            yield flush()
                            tokens = 0
            if held:
                yield flush()
        finally:
            known.forget()

    loss = F.col(loss_col).cast("long") if loss_col else F.lit(None).cast("long")
    slim = examples.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), loss.alias("loss"))
    return slim.mapInArrow(run, PIECES)


_open: dict[str, Ids] = {}


def tokenizer_of(path: str) -> Ids:
    """A Python worker's tokenizer, kept between its tasks without what they learnt."""
    if path not in _open:
        _open[path] = Ids(path)
    return _open[path]
