"""Packing of token sequences by best-fit decreasing.

Each document's ids (its end token included) are cut into full windows and one rest. Rests are placed in decreasing
length into the open window with the least room that still suffices, found in a segment tree over remaining
capacities. Packing runs where the tokens are made: each task packs groups of at most GROUP_TOKENS ids, so nothing is shuffled, no
document or source can overload a task, and a lost executor repeats its own tasks only. What best-fit leaves open
(about one window a group) is cut into runs whose lengths are powers of two, which need no padding.

Defined cases. Null or empty text: the end token alone. Repeated rows: each row is packed by itself. Null doc_id:
kept as null. Empty table: empty result. Other columns are ignored."""

from __future__ import annotations

import os
import re
import zlib
from array import array
from codecs import charmap_decode
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import lean

WINDOW, END = 2048, 1
#: Ids gathered in a task before they are packed, and ids passed on at once (about).
GROUP_TOKENS, PASSED = 2_000_000, 500_000
#: Characters of texts whose parts are tokenized together (about), parts in one call of the tokenizer, and parts known from texts before (in Arrow): how many, and from how many bytes on they are forgotten.
TOGETHER, AT_ONCE, KNOWN, HELD = 1_500_000, 200, 250_000, 16_000_000
#: A window with less free room than this is padded, not cut into powers of two.
SLACK = 16


#: Parts of texts whose ids a worker remembers, and the longest of them.
REMEMBERED, LONGEST, _MET = 100_000, 48, 1 << 22
_run = re.compile(r" (?:\s|\Z)")
# How byte-level vocabularies write bytes (those that print as themselves, the others from 256 on), and marks that stay together.
_PRINTED = [*range(33, 127), *range(161, 173), *range(174, 256)]
_WRITTEN = dict(zip([b for b in range(256) if b not in _PRINTED], map(chr, range(256, 512))))
_SPACE = _WRITTEN[32]
_TABLE = "".join(_WRITTEN.get(b, chr(b)) for b in range(256))
_PLAIN = "^[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+$"
# A token that would go on beyond the end of a word of such letters: ASCII, or bytes 0xC3 to 0xC9 with one of 0x80 to 0xBF.
_beyond = re.compile(f"(?:[A-Za-z]|(?:^|[{_TABLE[0xC3:0xCA]}])[{_TABLE[0x80:0xC0]}]){_SPACE}")
_MARKS = "!\"#$%&()*+,-./:;=?@[\\]^_`{}~"


class _Remembered(dict):
    """Ids by look-up of parts met twice, in two generations: when the younger is full, the elder is forgotten, which costs time and changes nothing."""

    def __init__(self, ids):
        super().__init__()
        self.ids, self.elder, self.met = ids, {}, bytearray(_MET)

    def __missing__(self, part: str) -> bytes:
        got = self.elder.get(part)
        if got is None:
            got = self.ids(part)
            place = hash(part) & (_MET - 1)
            if not self.met[place]:
                self.met[place] = 1
                return got
        if len(part) <= LONGEST and "\n" not in part:
            if len(self) >= REMEMBERED // 2:
                self.elder, self.met = dict(self), bytearray(_MET)
                self.clear()
            self[part] = got
        return got

    def forget(self) -> None:
        self.clear()
        self.elder, self.met = {}, bytearray(_MET)


class Encoder:
    """Ids of whole texts by the tokenizer, as bytes of unsigned 32-bit integers.

    The tokenizer parts a text before every space that a character other than white space follows, and around a line break
    between two such characters; what it makes of one part depends on no other. So the distinct parts of many texts are tokenized once,
    many in a row: each begins with the only token there that begins with a space. A part that is a word of letters, with or without marks behind
    it, is two of the tokenizer's own units at most: the word goes straight to its model, the marks are looked up. First parts of texts have no space
    before them and go one by one, those seen before are looked up. Texts in which white space or the end follows a space are tokenized as a whole."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model.tokenize
        self.marks, self.first, self.spaced = _Remembered(self._ids), _Remembered(partial(self._part, "", "")), _Remembered(partial(self._part, " ", _SPACE))
        self.line = self._ids("\n")
        self._know_none()
        vocabulary = self.whole.get_vocab()
        beyond = any(_beyond.search(token) for token in vocabulary) or getattr(self.whole.model, "ignore_merges", False)
        self.bare = None if beyond else Tokenizer(self.whole.model)
        self.begins = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        self.begins[[i for token, i in vocabulary.items() if token[0:1] == _SPACE]] = True

    def _ids(self, text: str) -> bytes:
        return array("I", self.whole.encode(text, add_special_tokens=False).ids).tobytes()

    def _part(self, space: str, written: str, part: str) -> bytes:
        word = part if part.isalpha() else part.rstrip(_MARKS)
        if word.isalpha():
            unit = written + word if word.isascii() else written + word.encode().decode("latin-1").translate(_WRITTEN) if max(word) < "\u0250" else None
            if unit is not None:
                got = array("I", [x.id for x in self.model(unit)]).tobytes()
                return got if len(word) == len(part) else got + self.marks[part[len(word) :]]
        elif "\n" in part:
            left, _, right = part.partition("\n")
            if left and right and not left[-1].isspace() and not right[0].isspace():
                return (self.spaced if space else self.first)[left] + self.line + self.first[right]
        return self._ids(space + part)

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]

    def encode_all(self, texts: list[str]) -> list[bytes]:
        heads, rests = [], []
        for text in texts:
            if _run.search(text):
                heads.append(self._ids(text))
                rests.append(None)
            else:
                head, space, rest = text.partition(" ")
                heads.append(self.first[head])
                rests.append(rest if space else None)
        parts = pc.split_pattern(pa.array(rests, pa.large_string()), " ")
        coded = parts.flatten().dictionary_encode()
        at, place = parts.offsets.to_numpy(), coded.indices.to_numpy()
        ids, ends = self._spelled(coded.dictionary)
        for i, head in enumerate(heads):
            if at[i] < at[i + 1]:
                mine = place[at[i] : at[i + 1]]
                last = ends[mine + 1]
                n = last - ends[mine]
                upto = n.cumsum()
                heads[i] = head + ids[np.repeat(last - upto, n) + np.arange(upto[-1])].tobytes()
        return heads

    def _spelled(self, parts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct parts, a space before each, in a row, and where each part's end (from 0 on): those of the word and of the marks behind it."""
        stems = pc.utf8_rtrim(parts, characters=_MARKS)
        stems = pc.if_else(pc.match_substring_regex(stems, _PLAIN), stems, parts)
        coded = stems.dictionary_encode()
        place = self._places(coded.dictionary)[coded.indices.to_numpy()]
        marked = np.flatnonzero(pc.not_equal(pc.binary_length(parts), pc.binary_length(stems)).to_numpy(zero_copy_only=False))
        tails = [self.marks[x[len(y) :]] for x, y in zip(parts.take(marked).to_pylist(), stems.take(marked).to_pylist())]
        behind = np.zeros(len(parts), np.int64)
        behind[marked] = [len(x) // 4 for x in tails]
        start, n = self.ends[place], self.ends[place + 1] - self.ends[place]
        ends = np.concatenate([[0], (n + behind).cumsum()])
        ids = np.zeros(ends[-1], np.uint32)
        within = np.arange(n.sum()) - np.repeat(n.cumsum() - n, n)
        ids[np.repeat(ends[:-1], n) + within] = self.ids[np.repeat(start, n) + within]
        n = behind[marked]
        ids[np.repeat(ends[marked + 1] - n.cumsum(), n) + np.arange(n.sum())] = np.frombuffer(b"".join(tails), np.uint32)
        return ids, ends

    def _places(self, words: pa.Array) -> np.ndarray:
        """Where each of the distinct words or other parts stands among the known ones, which from then on are these and earlier ones."""
        place = pc.index_in(words, self.known)
        if len(self.known) + place.null_count > KNOWN or self.known.nbytes + self.ids.nbytes > HELD:
            self._know_none()
            place = pc.index_in(words, self.known)
        new, before = words.filter(place.is_null()), len(self.known)
        plain = pc.match_substring_regex(new, _PLAIN)
        known, rows, lengths = [self.known], [self.ids], [np.diff(self.ends)]
        for some, ids_of in ((new.filter(plain), self._of_words), (new.filter(pc.invert(plain)), self._of_parts)):
            known.append(some)
            for lo in range(0, len(some), AT_ONCE):
                few = some[lo : lo + AT_ONCE].to_pylist()
                ids = np.frombuffer(array("I", ids_of(" " + " ".join(few))), np.uint32)
                begin = np.flatnonzero(self.begins[ids])
                if len(begin) == len(few):
                    lengths.append(np.diff(begin, append=len(ids)))
                else:  # a tokenizer that writes spaces otherwise
                    each = [self.spaced[x] for x in few]
                    ids = np.frombuffer(b"".join(each), np.uint32)
                    lengths.append(np.array([len(x) // 4 for x in each], np.int64))
                rows.append(ids)
        self.known, self.ids, self.ends = pa.concat_arrays(known), np.concatenate(rows), np.concatenate([[0], np.concatenate(lengths).cumsum()])
        found, plain = place.fill_null(-1).to_numpy().astype(np.int64), plain.to_numpy(zero_copy_only=False)
        found[found < 0] = before + np.where(plain, plain.cumsum() - 1, plain.sum() + (~plain).cumsum() - 1)
        return found

    def _of_words(self, words: str) -> list[int]:
        """No token goes beyond a word, so the model alone makes of words in a row what it makes of each."""
        if self.bare is None:
            return self._of_parts(words)
        return self.bare.encode_batch_fast([charmap_decode(words.encode(), "strict", _TABLE)[0]], add_special_tokens=False)[0].ids

    def _of_parts(self, parts: str) -> list[int]:
        return self.whole.encode_batch_fast([parts], add_special_tokens=False)[0].ids

    def _know_none(self) -> None:
        self.known, self.ids, self.ends = pa.array([], pa.large_string()), np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def forget(self) -> None:
        """Let go of what was remembered: a worker lives on through all stages."""
        for parts in (self.marks, self.first, self.spaced):
            parts.forget()
        self._know_none()


_encoders: dict[str, Encoder] = {}


def encoder(path: str | None = None) -> Encoder:
    """path: a file of the tokenizers library; by default public_tokenizers.path("byte_bpe_50k.json")."""
    if path is None:
        import public_tokenizers

        path = str(public_tokenizers.path("byte_bpe_50k.json"))
    if path not in _encoders:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _encoders[path] = Encoder(path)
    return _encoders[path]


class OpenWindows:
    """Open windows by remaining capacity: a segment tree whose leaves say whether any window has just that much room."""

    def __init__(self, window: int):
        self.size = 1 << window.bit_length()
        self.any = bytearray(2 * self.size)
        self.by_room: list[list[int]] = [[] for _ in range(self.size)]

    def add(self, room: int, name: int) -> None:
        self.by_room[room].append(name)
        i = room + self.size
        while i and not self.any[i]:
            self.any[i] = 1
            i >>= 1

    def tightest(self, need: int) -> tuple[int, int] | None:
        """Take out the window with the least room >= need, as (room, name); None if there is none."""
        i = need + self.size
        if not self.any[i]:
            while i > 1 and not (i % 2 == 0 and self.any[i + 1]):
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.size:
                i = 2 * i if self.any[2 * i] else 2 * i + 1
        room = i - self.size
        name = self.by_room[room].pop()
        while i and not (self.by_room[room] if i >= self.size else self.any[2 * i] or self.any[2 * i + 1]):
            self.any[i] = 0
            i >>= 1
        return room, name


def best_fit_decreasing(lengths: list[int], window: int = WINDOW) -> tuple[list[int], list[int], int]:
    """For each piece its window and its offset there; the number of windows. No piece is longer than a window."""
    at, offset, rooms, n = [0] * len(lengths), [0] * len(lengths), OpenWindows(window), 0
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        size = lengths[i]
        found = rooms.tightest(size) if size < window else None
        room, name = found or (window, n)
        n += found is None
        at[i], offset[i] = name, window - room
        if room > size:
            rooms.add(room - size, name)
    return at, offset, n


def _packed(docs: list[tuple], ids: list[bytes], window: int, first: int) -> tuple[list[tuple], int]:
    """Rows (doc, start, length, tokens of the document, sequence, offset) for a group; sequences used."""
    pieces = []
    for d, raw in enumerate(ids):
        total = len(raw) // 4
        pieces += [(d, s, min(window, total - s), total) for s in range(0, total, window)]
    at, offset, n = best_fit_decreasing([p[2] for p in pieces], window)
    held: list[list[int]] = [[] for _ in range(n)]
    for i, w in enumerate(at):
        held[w].append(i)
    rows, more = [], n
    for w, inside in enumerate(held):
        inside.sort(key=offset.__getitem__)
        fill = sum(pieces[i][2] for i in inside)
        if window - fill < SLACK:
            rows += [(*pieces[i], first + w, offset[i]) for i in inside]
            continue
        target, room, used = w, 1 << (fill.bit_length() - 1), 0  # the largest power of two first, then the next
        for i in inside:
            d, s, length, total = pieces[i]
            while length:
                take = min(length, room - used)
                rows.append((d, s, take, total, first + target, used))
                s, length, used, fill = s + take, length - take, used + take, fill - take
                if used == room and fill:
                    target, more, room, used = more, more + 1, 1 << (fill.bit_length() - 1), 0
    return rows, more


def _encoded(texts: pa.Array, encode) -> Iterator[bytes]:
    held: list[str] = []
    size = 0
    for text in texts:
        held.append(text.as_py() or "")
        size += len(held[-1])
        if size >= TOGETHER:
            yield from encode(held)
            held, size = [], 0
    if held:
        yield from encode(held)


def _packer(window: int, end: int, path: str | None, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, tail = encoder(path).encode_all, array("I", [end]).tobytes()
        state = {"next": TaskContext.get().partitionId() << 40}
        docs: list = []
        ids: list[bytes] = []
        size = 0

        def flush():
            rows, used = _packed(docs, ids, window, state["next"])
            state["next"] += used
            lo = 0
            while lo < len(rows):
                hi, held = lo, 0
                while hi < len(rows) and held < PASSED:
                    held, hi = held + rows[hi][2], hi + 1
                d, start, length, total, seq, off = zip(*rows[lo:hi])
                lo = hi
                raw = [ids[x][4 * s : 4 * (s + n)] for x, s, n in zip(d, start, length)]
                cols = [pa.array([docs[x] for x in d], state["type"]), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array([zlib.crc32(r) for r in raw], pa.int64()), pa.array(total, pa.int64()), pa.array(seq, pa.int64()), pa.array(off, pa.int64())]
                names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
                if with_ids:
                    ends = pa.array(np.cumsum([0, *length]), pa.int32())
                    cols.append(pa.ListArray.from_arrays(ends, pa.Array.from_buffers(pa.int32(), sum(length), [None, pa.py_buffer(b"".join(raw))])))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(cols, names)

        for batch in batches:
            state["type"] = batch.schema.field("doc_id").type
            for doc, got in zip(batch.column("doc_id").to_pylist(), _encoded(batch.column("text"), encode)):
                docs.append(doc)
                ids.append(got + tail)
                size += len(ids[-1]) // 4
                if size >= GROUP_TOKENS:
                    yield from flush()
                    docs.clear()
                    ids.clear()
                    size = 0
        if docs:
            yield from flush()
        docs.clear()
        ids.clear()
        encoder(path).forget()

    return run


def pack(docs: DataFrame, window: int = WINDOW, end: int = END, tokenizer: str | None = None, with_ids: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset and, if asked for, the ids.

    tokenizer: a file of the tokenizers library, see `encoder`. The end token is the last id of each document. A sequence holds `window` ids at most; its offsets are gapless."""
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids array<int>" * with_ids
    return docs.mapInArrow(lean(_packer(window, end, tokenizer, with_ids)), schema)
