"""BPE encoding and decoding that reuses content-defined chunks across documents.

Texts are cut where a rolling hash of their last 32 bytes hits a mask, so equal
passages give equal chunks wherever they stand.  One pass over the texts counts
chunk digests.  A second pass encodes documents at once if none of their chunks
occurs twice; the others are written to the shared scratch folder.  There each
distinct repeated chunk is encoded once, and its ids go to every document that
holds it.  Ids of chunks are joined, and each join is repaired: the words
around it are encoded again, with more words on both sides until both sides
agree with the ids of the chunks.  A document whose joins never agree is encoded
whole, so the ids are those of the library in every case.

The second pass asks a Bloom filter of fixed size which digests occur twice.  It
is the only broadcast; false answers cost a chunk's transport, never a result.

Words are cached per worker where the tokenizer drops blanks (its ids of a text
are those of its blank-delimited words); where it also keeps a run of letters
whole and in lower case, letters and the signs behind them are words of their own.  With other tokenizers agreement beside a
join proves nothing about it: their joined documents are all encoded whole.

Defined results
  - null text counts as empty: no ids, empty decoded text;
  - null and repeated ids pass through, a row in gives a row out;
  - strings of special tokens inside a text become those tokens, as the library does by default;
  - 128-bit digests stand for chunks;
  - only the id and text columns are read, whatever other columns are named.
"""

from __future__ import annotations

import json
import os
import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from refinery.session import release

from .common import BLANKS, Scratch
from .tokens import release_memory

AVERAGE = 1024  # bytes of a chunk
LEAST = 256
MOST = 1 << 16
WINDOW = 32
FILTER_BYTES = 16 << 20
FILTER_PROBES = 4
BATCH_BYTES = 4 << 20
CALL_TEXTS = 4096  # of one call of the library, whose results are large objects
GROUP_WORDS = 256  # encoded as one text
FEW_WORDS = 512  # different ones of a call that are not worth parting
AROUND = (1, 4, 16)  # words on both sides of a join that must agree
_PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_BLANK_BYTES = np.zeros(256, bool)
_BLANK_BYTES[list(BLANKS.encode())] = True
_LETTER_BYTES = np.zeros(256, bool)  # of the letters of ASCII and those of U+00C0 to U+00FF
_LETTER_BYTES[[*range(65, 91), *range(97, 123), *range(0x80, 0xC0), 0xC3]] = True
_LETTER_BYTES[[0x97, 0xB7]] = False  # behind 0xC3 the signs U+00D7 and U+00F7
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_GEAR = np.array([xxhash.xxh32_intdigest(bytes([b]), 7) for b in range(256)], np.uint32)


def rolling_hash(data: np.ndarray) -> np.ndarray:
    """At each byte the gear hash of the 32 bytes that end there, by doubling the window."""
    h = _GEAR[data]
    for k in (1, 2, 4, 8, 16):
        h[k:] = h[k:] + (h[:-k] << np.uint32(k))
    return h


def cut_places(texts: list[bytes], average: int = AVERAGE, least: int = LEAST, most: int = MOST) -> list[list[int]]:
    """Where each text's chunks begin, 0 first; never inside a UTF-8 character."""
    data = np.frombuffer(b"".join(texts) + b"\0", np.uint8)
    if len(data) <= 1:
        return [[0] for _ in texts]
    after = data[1:]
    mask = np.uint32((average - 1) << 16)
    marks = np.flatnonzero((rolling_hash(data)[:-1] & mask == 0) & ((after & 0xC0) != 0x80)) + 1
    ends = np.cumsum([len(t) for t in texts])
    owner_from = np.searchsorted(marks, ends - [len(t) for t in texts])
    owner_to = np.searchsorted(marks, ends, "left")
    out, begin = [], 0
    for text, lo, hi, end in zip(texts, owner_from, owner_to, ends.tolist()):
        places, last = [0], 0
        for place in (marks[lo:hi] - begin).tolist() + [len(text)]:
            while place - last > most:  # no mark in sight
                last += most
                while last < len(text) and text[last] & 0xC0 == 0x80:
                    last += 1
                if last < place:
                    places.append(last)
            if least <= place - last and place < len(text):
                places.append(place)
                last = place
        out.append(places)
        begin = end
    return out


def chunks_of(text: bytes, places: list[int]) -> list[bytes]:
    return [text[a:b] for a, b in zip(places, [*places[1:], len(text)])]


class Library:
    """The tokenizers library without truncation and padding, with a cache of words where that is exact."""

    def __init__(self, path: str, limit: int = 200_000, longest: int = 48):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs one worker per core
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.model.no_truncation()
        self.model.no_padding()
        self.limit, self.longest = limit, longest
        self.words: dict[str, bytes] = {}
        spec = json.loads(self.model.to_str())
        self.by_word = self._drops_blanks(spec)
        self.mark = self._mark(spec)
        self.ends = self._piece_ends(spec) if self.by_word else None
        tokens = "".join(t["content"] for t in spec["added_tokens"])
        self.signs = "".join(c for c in string.punctuation if c not in tokens)
        self.plain = not spec["decoder"]
        size = self.model.get_vocab_size(with_added_tokens=True)
        self.short = size <= 1 << 16
        self.pieces = pa.array([self.model.id_to_token(i) for i in range(size)], pa.string())

    @staticmethod
    def _drops_blanks(spec: dict) -> bool:
        """Blanks are removed by the first pre-tokenizer, and nothing else looks across them."""
        first = (spec["pre_tokenizer"] or {}).get("pretokenizers", [{}])[0]
        kinds = {n["type"] for n in (spec["normalizer"] or {}).get("normalizers", [])}
        added = any(t["lstrip"] or t["rstrip"] or any(b in t["content"] for b in BLANKS) for t in spec["added_tokens"])
        return (first.get("type"), first.get("behavior"), first.get("invert")) == ("Split", "Removed", True) and \
            "\\s" not in first["pattern"].get("Regex", "\\s").replace("[^\\s", "") and \
            kinds <= {"NFC", "Replace", "Lowercase"} and not spec["post_processor"] and not added

    @staticmethod
    def _mark(spec: dict) -> tuple[str, int] | None:
        """A special token that keeps the texts on its two sides apart, whatever they are."""
        added = [t["content"] for t in spec["added_tokens"]]
        for t in spec["added_tokens"]:
            mark = t["content"]
            alone = t["special"] and not (t["single_word"] or t["normalized"] or t["lstrip"] or t["rstrip"])
            # no token begins before the mark and ends in it, and no longer one begins with it
            if alone and not any(mark[0] in a[1:] or a != mark and a.startswith(mark) for a in added):
                return mark, t["id"]
        return None

    def _piece_ends(self, spec: dict) -> np.ndarray | None:
        """Of each id, whether it ends a piece, if every run of letters is a piece and upper case means nothing; else None."""
        suffix = spec["model"].get("end_of_word_suffix")
        steps = (spec["normalizer"] or {}).get("normalizers", [])
        cased = {"type": "Lowercase"} not in steps
        replaced = any(n["type"] == "Replace" and n["pattern"] != {"Regex": "\\s+"} for n in steps)
        first, *rest = spec["pre_tokenizer"]["pretokenizers"]
        bytewise = [(r["type"], r.get("add_prefix_space"), r.get("use_regex")) for r in rest] == [("ByteLevel", False, False)]
        if not suffix or cased or replaced or not bytewise or first["pattern"].get("Regex") != _PIECES:
            return None
        ends = np.zeros(self.model.get_vocab_size(with_added_tokens=True), bool)
        ends[[i for token, i in spec["model"]["vocab"].items() if token.endswith(suffix)]] = True
        return ends

    def whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for i in range(0, len(texts), CALL_TEXTS)
                for e in self.model.encode_batch_fast(texts[i:i + CALL_TEXTS], add_special_tokens=False)]

    def _apart(self, words: list[str]) -> list[bytes]:
        """Ids of each word; a group of them is one text, with a special token between two."""
        if self.mark is None:
            return self.whole(words)
        (mark, number), out = self.mark, []
        groups = [words[i:i + GROUP_WORDS] for i in range(0, len(words), GROUP_WORDS)]
        for group, raw in zip(groups, self.whole([mark.join(g) for g in groups])):
            cuts = (4 * np.flatnonzero(np.frombuffer(raw, "<u4") == number)).tolist()
            if len(cuts) != len(group) - 1:  # a word holds the token
                out += self.whole(group)
                continue
            out += [raw[a:b] for a, b in zip([0, *(c + 4 for c in cuts)], [*cuts, len(raw)])]
        return out

    def _spaced(self, words: list[str]) -> list[bytes]:
        """Ids of each word of letters; a group of them is one text with blanks between, and each is one piece."""
        out, groups = [], [words[i:i + GROUP_WORDS] for i in range(0, len(words), GROUP_WORDS)]
        for group, raw in zip(groups, self.whole([" ".join(g) for g in groups])):
            cuts = (4 * np.flatnonzero(self.ends[np.frombuffer(raw, "<u4")]) + 4).tolist()
            if len(cuts) != len(group) or cuts[-1] != len(raw):  # a character the model does not know
                out += self.whole(group)
                continue
            out += [raw[a:b] for a, b in zip([0, *cuts], cuts)]
        return out

    def narrow(self, ids: bytes) -> bytes:
        """Ids as they are kept between stages: two bytes each if the vocabulary allows."""
        return np.frombuffer(ids, "<u4").astype("<u2").tobytes() if self.short else ids

    def widen(self, ids: bytes) -> bytes:
        return np.frombuffer(ids, "<u2").astype("<u4").tobytes() if self.short else ids

    def _learn(self, words: list[str]) -> dict[str, bytes]:
        found = {w: self.words.get(w) for w in words}
        new = [w for w, ids in found.items() if ids is None]
        if self.ends is not None:
            letters = [w for w in new if w.isalpha() and (w.isascii() or max(w) < "\u0100")]
            found.update(zip(letters, self._spaced(letters)))
        rest = [w for w in new if found[w] is None]
        found.update(zip(rest, self._apart(rest)))
        if len(self.words) > self.limit:
            self.words.clear()
        self.words.update((w, found[w]) for w in new if len(w) <= self.longest)
        return found

    def _parts(self, words: pa.LargeStringArray) -> tuple[pa.Array, np.ndarray]:
        """Two strings of each word as places in a list of them: its letters, in lower case, and the signs behind;
        if it has anything else, the word as it is and nothing."""
        at = np.frombuffer(words.buffers()[1], "<i8")[words.offset:words.offset + len(words) + 1]
        data, at = np.frombuffer(words.buffers()[2], np.uint8)[at[0]:at[-1]], at - at[0]
        cut = at[:-1] + np.asarray(pc.binary_length(pc.ascii_rtrim(words, self.signs)))
        letters = np.concatenate([[0], np.cumsum(_LETTER_BYTES[data])])
        plain = (cut > at[:-1]) & (letters[cut] - letters[at[:-1]] == cut - at[:-1])
        bounds = np.append(np.column_stack([at[:-1], np.where(plain, cut, at[1:])]).ravel(), at[-1])
        data = np.where(np.repeat(plain, np.diff(at)), _LOWER[data], data)
        halves = pa.LargeStringArray.from_buffers(2 * len(words), pa.py_buffer(bounds), pa.py_buffer(data)).dictionary_encode()
        return halves.dictionary, np.asarray(halves.indices).reshape(-1, 2)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian uint32 bytes."""
        if not self.by_word:
            return self.whole(texts)
        if not texts:
            return []
        lists = pc.ascii_split_whitespace(pa.array(texts, pa.large_string()))
        at = np.asarray(lists.offsets, np.int64)
        coded = lists.flatten().dictionary_encode()
        known, code = coded.dictionary, np.asarray(coded.indices)[:, None]
        if self.ends is not None and len(known) > FEW_WORDS:
            known, parts = self._parts(known)
            code = parts[code[:, 0]]
        known = known.to_pylist()
        learned = self._learn(known)
        ids = [learned[w] for w in known]
        sizes = np.array([len(i) // 4 for i in ids], np.int64)
        starts = np.cumsum(sizes) - sizes
        pool = np.frombuffer(b"".join(ids), "<u4")
        at, code = at * code.shape[1], code.ravel()
        take = sizes[code]
        ends = np.cumsum(take)
        flat = pool[np.repeat(starts[code] - ends + take, take) + np.arange(int(take.sum()))]
        places = np.concatenate([[0], ends])[at]
        return [flat[a:b].tobytes() for a, b in zip(places, places[1:])]

    def decode(self, ids: list[bytes]) -> list[str]:
        """As the library decodes them, special tokens kept."""
        if not self.plain:
            return self.model.decode_batch([np.frombuffer(i, "<u4").tolist() for i in ids], skip_special_tokens=False)
        flat = np.frombuffer(b"".join(ids), "<u4").astype(np.int64)
        at = pa.array(np.cumsum([0, *(len(i) // 4 for i in ids)]), pa.int32())
        return pc.binary_join(pa.ListArray.from_arrays(at, self.pieces.take(pa.array(flat))), " ").to_pylist()

    def join(self, text: bytes, places: list[int], parts: list[bytes]) -> bytes:
        """Ids of a text from those of its chunks, every join repaired."""
        if len(places) == 1:
            return parts[0]
        for around in AROUND if self.by_word else ():  # where blanks count, agreement beside a join proves nothing
            ids = self._repaired(text, places, parts, around)
            if ids is not None:
                return ids
        return self.whole([text.decode("utf-8", "surrogatepass")])[0]

    def _repaired(self, text: bytes, places: list[int], parts: list[bytes], around: int) -> bytes | None:
        """Ids with the word across each join encoded again; None if the words around a join disagree with the chunks."""
        blank = np.concatenate([[True], _BLANK_BYTES[np.frombuffer(text, np.uint8)], [True]])
        edges = np.flatnonzero(np.diff(blank))
        starts, ends = edges[0::2], edges[1::2]
        stops = [*places[1:], len(text)]
        joins, i, free = [], 1, 0
        while i < len(places):
            cut = places[i]
            w = int(np.searchsorted(ends, cut, "right"))  # the first word that ends behind the cut
            inside = w < len(starts) and starts[w] < cut
            a, b = (int(starts[w]), int(ends[w])) if inside else (cut, cut)
            right = i
            while stops[right] < b:  # the word spans whole chunks
                right += 1
            first = max(int(np.searchsorted(starts, free)), w - around)
            last = min(int(np.searchsorted(ends, stops[right], "right")), w + inside + around) - 1
            before = text[int(starts[first]):a] if first < w else b""
            after = text[b:int(ends[last])] if last >= w + inside else b""
            joins.append((right, before, text[a:b], after, text[a:cut], text[places[right]:b]))
            i, free = right + 1, b
        strings = [x.decode("utf-8", "surrogatepass") for j in joins for x in j[1:]]
        found = self.encode(strings)
        known = self.whole(["".join(strings[5 * k:5 * k + 3]) for k in range(len(joins))])
        out, held = [], parts[0]
        for k, (right, *_) in enumerate(joins):
            before, seam, after, rear, front = found[5 * k:5 * k + 5]
            if known[k] != before + seam + after or not held.endswith(before + rear) or \
                    not parts[right].startswith(front + after):
                return None
            out += (held[:len(held) - len(rear)], seam)
            held = parts[right][len(front):]
        return b"".join([*out, held])


_LIBRARIES: dict[str, Library] = {}


def library(path: str) -> Library:
    """This worker's library object for a tokenizer file; one at a time stays."""
    if path not in _LIBRARIES:
        pa.set_memory_pool(pa.system_memory_pool())  # gives large buffers back at once
        _LIBRARIES.clear()
        _LIBRARIES[path] = Library(path)
    return _LIBRARIES[path]


def _groups(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.RecordBatch]:
    """Slices of a bounded number of text bytes, or one row."""
    for batch in batches:
        sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), np.int64)
        group = (np.cumsum(sizes) - sizes) // BATCH_BYTES
        cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            if b > a:
                yield batch.slice(a, b - a)


def _digests(texts: list[bytes], places: list[list[int]]) -> np.ndarray:
    """(h1, h2) of all chunks of the texts."""
    raw = b"".join(xxhash.xxh3_128_digest(c) for t, p in zip(texts, places) for c in chunks_of(t, p))
    return np.frombuffer(raw, "<i8").reshape(-1, 2)


def _raw(column: pa.Array) -> list[bytes]:
    return pc.fill_null(column, "").cast(pa.large_string()).cast(pa.large_binary()).to_pylist()


def _count_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _groups(batches, "text"):
        texts = _raw(batch.column("text"))
        found, n = np.unique(_digests(texts, cut_places(texts)), axis=0, return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1]), pa.array(n)], names=["h1", "h2", "n"])
    release_memory()


def _bits(h1: np.ndarray, h2: np.ndarray, size: int) -> list[np.ndarray]:
    """The filter's bits of digests, by double hashing."""
    a, b = h1.view(np.uint64), h2.view(np.uint64) | np.uint64(1)
    return [((a + np.uint64(k) * b) >> np.uint64(20)) % np.uint64(8 * size) for k in range(FILTER_PROBES)]


def shared_filter(docs: DataFrame, size: int = FILTER_BYTES) -> bytes:
    """Bloom filter of ``size`` bytes of the chunk digests that occur twice or more in a (doc_id, text) frame."""
    counted = docs.select("text").mapInArrow(_count_digests, "h1 long, h2 long, n long")
    shared = counted.groupBy("h1", "h2").agg(F.sum("n").alias("n")).filter("n > 1").select("h1", "h2")

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = [np.asarray(batch.column(i), np.int64) for i in (0, 1)]
            bits = np.unique(np.concatenate(_bits(*h, size)))
            words = bits >> np.uint64(6)
            first = np.flatnonzero(np.diff(words, prepend=np.uint64(1 << 63)))
            if len(first):
                ored = np.bitwise_or.reduceat(np.uint64(1) << (bits & np.uint64(63)), first)
                yield pa.RecordBatch.from_arrays([pa.array(words[first].astype(np.int64)), pa.array(ored.view(np.int64))],
                                                 names=["word", "bits"])

    words = shared.mapInArrow(mark, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits"))
    table = np.zeros(size // 8, np.int64)
    found = words.toArrow()  # a fixed number of words at most
    table[np.asarray(found.column("word"))] = np.asarray(found.column("bits"))
    return table.tobytes()


_FIRST = T.StructType([
    T.StructField("key", T.LongType()), T.StructField("text", T.StringType()), T.StructField("ids", T.BinaryType()),
    T.StructField("chunks", T.ArrayType(T.StructType([
        T.StructField("no", T.IntegerType()), T.StructField("h1", T.LongType()), T.StructField("h2", T.LongType()),
        T.StructField("begin", T.IntegerType()), T.StructField("end", T.IntegerType()),
        T.StructField("shared", T.BooleanType())])))])


def _first_pass(docs: DataFrame, path: str, filter_bytes) -> DataFrame:
    """Documents without a shared chunk with their ids; the others with their text and its chunks."""
    schema = T.StructType([docs.schema["doc_id"], *_FIRST.fields])
    chunk_type = pa.struct([("no", pa.int32()), ("h1", pa.int64()), ("h2", pa.int64()), ("begin", pa.int32()),
                            ("end", pa.int32()), ("shared", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lib, n = library(path), TaskContext.get().partitionId() << 33
        table = np.frombuffer(filter_bytes.value, np.uint64)
        for batch in _groups(batches, "text"):
            texts = _raw(batch.column("text"))
            places = cut_places(texts)
            h = _digests(texts, places)
            hit = np.ones(len(h), bool)
            for bits in _bits(np.ascontiguousarray(h[:, 0]), np.ascontiguousarray(h[:, 1]), table.nbytes):
                hit &= (table[bits >> np.uint64(6)] >> (bits & np.uint64(63)) & np.uint64(1)).astype(bool)
            at = np.cumsum([0, *map(len, places)])
            held = np.add.reduceat(hit, at[:-1]) > 0
            strings = [t or "" for t in batch.column("text").to_pylist()]
            own = [lib.narrow(i) for i in lib.encode([t for t, waits in zip(strings, held.tolist()) if not waits])]
            flat = {"no": np.concatenate([np.arange(len(p)) for p in places]), "h1": h[:, 0], "h2": h[:, 1],
                    "begin": np.concatenate(places), "shared": hit,
                    "end": np.concatenate([[*p[1:], len(t)] for t, p in zip(texts, places)])}
            chunks = pa.StructArray.from_arrays([pa.array(flat[f.name], f.type) for f in chunk_type], fields=list(chunk_type))
            lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), chunks, mask=pa.array(~held))
            ids, k = [], 0
            for waits in held.tolist():
                ids.append(None if waits else own[k])
                k += not waits
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(np.arange(n, n + len(texts))),
                 pa.array([t if waits else None for t, waits in zip(strings, held.tolist())], pa.string()),
                 pa.array(ids, pa.binary()), lists], names=schema.names)
            n += len(texts)
        release_memory()

    return docs.mapInArrow(run, schema)


def encode_documents(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text: str = "text",
                     filter_size: int = FILTER_BYTES) -> DataFrame:
    """(doc_id, ids) of every row, ids as little-endian unsigned 32-bit integers."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "chunk-bpe")
    quote = lambda c: F.col("`{}`".format(c.replace("`", "``")))
    docs = docs.select(quote(id_col).alias("doc_id"), quote(text).alias("text"))
    filter_bytes = spark.sparkContext.broadcast(shared_filter(docs, filter_size))
    first = scratch.table(_first_pass(docs, tokenizer_path, filter_bytes), "first")
    done, waiting = first.filter("text is null").select("doc_id", "ids"), first.filter("text is not null")

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The shared chunks' texts, each once per batch."""
        for batch in batches:
            found = {}
            for raw, chunks in zip(_raw(batch.column("text")), batch.column("chunks")):
                for c in chunks.as_py():
                    if c["shared"]:
                        found.setdefault((c["h1"], c["h2"]), raw[c["begin"]:c["end"]])
            h = list(found)
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in h], pa.int64()), pa.array([x[1] for x in h], pa.int64()),
                                              pa.array(list(found.values()), pa.binary())], names=["h1", "h2", "chunk"])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lib = library(tokenizer_path)
        for batch in _groups(batches, "chunk"):
            ids = map(lib.narrow, lib.encode([c.decode("utf-8", "surrogatepass") for c in batch.column("chunk").to_pylist()]))
            yield pa.RecordBatch.from_arrays([batch.column("h1"), batch.column("h2"), pa.array(list(ids), pa.binary())],
                                             names=["h1", "h2", "ids"])

    texts = waiting.select("text", "chunks").mapInArrow(pick, "h1 long, h2 long, chunk binary")
    once = texts.groupBy("h1", "h2").agg(F.max("chunk").alias("chunk"))
    pieces = scratch.table(once.mapInArrow(encode, "h1 long, h2 long, ids binary"), "pieces")
    uses = waiting.select("key", F.explode("chunks").alias("c")).filter("c.shared").select("key", "c.no", "c.h1", "c.h2")
    uses = scratch.table(uses, "uses")
    release(spark)  # the shuffle files of the counts and of the chunks, before the texts are sent
    parts = uses.join(pieces, ["h1", "h2"]).groupBy("key").agg(F.collect_list(F.struct("no", "ids")).alias("parts"))

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lib = library(tokenizer_path)
        for batch in _groups(batches, "text"):
            held, own = [], []  # the documents, and the chunks that only they have
            for raw, chunks, parts in zip(_raw(batch.column("text")), batch.column("chunks"), batch.column("parts")):
                places = chunks.values.field("begin").to_pylist()
                found: list[bytes | None] = [None] * len(places)
                for no, ids in zip(parts.values.field("no").to_pylist(), parts.values.field("ids").to_pylist()):
                    found[no] = lib.widen(ids)
                texts = chunks_of(raw, places)
                own += [(found, i, texts[i].decode("utf-8", "surrogatepass")) for i, ids in enumerate(found) if ids is None]
                held.append((raw, places, found))
            for (found, i, _), ids in zip(own, lib.encode([text for *_, text in own])):
                found[i] = ids
            out = [lib.join(*document) for document in held]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.binary())], names=["doc_id", "ids"])
        release_memory()

    def widen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lib = library(tokenizer_path)
        for batch in batches:
            ids = [lib.widen(i) for i in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.binary())], names=["doc_id", "ids"])

    schema = T.StructType([docs.schema["doc_id"], T.StructField("ids", T.BinaryType())])
    rest = waiting.select("key", "doc_id", "text", "chunks").join(parts, "key")
    return done.mapInArrow(widen, schema).union(rest.select("doc_id", "text", "chunks", "parts").mapInArrow(assemble, schema))


def decode_documents(encoded: DataFrame, tokenizer_path: str) -> DataFrame:
    """Adds ``decoded`` to (doc_id, ids)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lib = library(tokenizer_path)
        for batch in _groups(batches, "ids"):
            texts = lib.decode(batch.column("ids").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("ids"), pa.array(texts, pa.string())],
                                             names=["doc_id", "ids", "decoded"])
        release_memory()

    return encoded.select("doc_id", "ids").mapInArrow(
        run, T.StructType([*encoded.select("doc_id", "ids").schema.fields, T.StructField("decoded", T.StringType())]))
