"""Token ids of whole texts, with a public tokenizer file and a bounded cache of words.

The pre-tokenizer of a byte-level BPE always starts a new piece at a single
space between two other non-blank characters, and takes a single line feed
between two as a piece of its own; merges never cross pieces.  So a text is cut
there, each distinct word is encoded once while a worker keeps it, and the ids
are joined.  The result equals encoding the whole text.
"""

from __future__ import annotations

import os
import re
import string
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

ID_BYTES = 4  # little-endian unsigned 32-bit ids
_SAFE_SPACE = re.compile(r"(?<=\S) (?=\S)")
_BLANK = re.compile(r"\s")
_BEFORE_MARKS = r"^(?s:.*)[^!-/:-@\[-`{-~]"  # up to the last character that is no ASCII punctuation
_GROUP = 256
CALL_BYTES = 64 << 20  # of text handled at once, unless one text is longer


class ChunkEncoder:
    """Ids of texts as little-endian uint32 bytes.

    Words met once wait in ``new``; a second meeting moves them to ``kept``.
    Each holds at most ``limit`` words of at most ``longest`` characters.
    """

    def __init__(self, path: str, limit: int = 200_000, longest: int = 48):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs one worker per core
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.model.encode_special_tokens = True
        self.limit, self.longest = limit, longest
        # by what stands before the word
        self.kept: dict[str, dict[str, bytes]] = {"": {}, " ": {}}
        self.new: dict[str, dict[str, bytes]] = {"": {}, " ": {}}
        self.marks: dict[str, bytes] = {}
        feed = self.model.encode("\n", add_special_tokens=False).ids
        self.feed = feed[0] if len(feed) == 1 else -1  # -1: a tokenizer of another kind
        self.feed_bytes = np.array(feed, "<u4").tobytes()

    def _ids(self, texts: list[str]) -> list[bytes]:
        found = self.model.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, "<u4").tobytes() for e in found]

    def _words_ids(self, words: list[str], lead: str) -> list[bytes]:
        """Ids of words without blanks, each behind ``lead``; a line feed keeps them apart in one long text."""
        groups = [words[i:i + _GROUP] for i in range(0, len(words), _GROUP)]
        found = self.model.encode_batch_fast([lead + f"\n{lead}".join(g) for g in groups], add_special_tokens=False)
        out: list[bytes] = []
        for group, encoded in zip(groups, found):
            ids = np.array(encoded.ids, "<u4")
            cuts = np.flatnonzero(ids == self.feed)
            if len(cuts) != len(group) - 1:
                out += self._ids([lead + w for w in group])
                continue
            raw, at = ids.tobytes(), 0
            for cut in (cuts * ID_BYTES).tolist():
                out.append(raw[at:cut])
                at = cut + ID_BYTES
            out.append(raw[at:])
        return out

    def _whole(self, text: str) -> bytes:
        """A text with other blanks than single spaces and line feeds."""
        return b"".join(self._ids([c if i == 0 else " " + c for i, c in enumerate(_SAFE_SPACE.split(text))]))

    def _ids_of(self, words: pa.Array, lead: str) -> tuple[list[bytes], np.ndarray]:
        """Ids of distinct words, and which of them are no safe cut (blank inside, or empty)."""
        words = words.to_pylist()
        unsafe = np.zeros(len(words), bool)
        if "" in words or _BLANK.search("".join(words)):
            unsafe[:] = [not w or bool(_BLANK.search(w)) for w in words]
        kept, waiting = self.kept[lead], self.new[lead]
        found = list(map(kept.get, words))
        missing = [i for i, ids in enumerate(found) if ids is None and not unsafe[i]]
        unknown = []
        for i in missing:
            ids = waiting.pop(words[i], None)
            if ids is None:
                unknown.append(i)
            else:
                found[i] = kept[words[i]] = ids
        new = list({words[i] for i in unknown})
        learned = dict(zip(new, self._words_ids(new, lead)))
        for i in unknown:
            found[i] = learned[words[i]]
        if len(waiting) > self.limit:
            waiting.clear()
        waiting.update([x for x in learned.items() if len(x[0]) <= self.longest])
        if len(kept) > self.limit:
            kept.clear()
        return [x or b"" for x in found], unsafe

    def _mark_ids(self, marks: pa.Array) -> list[bytes]:
        """Ids of the runs of punctuation behind words."""
        marks = marks.to_pylist()
        if len(self.marks) > 50_000:
            self.marks.clear()
        new = [m for m in marks if m and m not in self.marks]
        self.marks.update(zip(new, self._ids(new)))
        return [self.marks[m] if m else b"" for m in marks]

    def encode_column(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a column of texts (null: empty) in a row, and where each text's begin (one more at the end)."""
        texts = pc.fill_null(texts, "").cast(pa.large_string())
        lines = pc.split_pattern(texts, "\n")
        words = pc.split_pattern(lines.flatten(), " ")
        line_at, word_at = (np.asarray(x.offsets, np.int64) for x in (lines, words))
        flat = words.flatten()
        n, d = len(flat), len(texts)
        first = np.zeros(n, bool)
        first[word_at[:-1]] = True
        # every word is two items: itself, or its letters and the marks behind them, each a piece of its own
        start, size = np.zeros((n, 2), np.int32), np.zeros((n, 2), np.int32)
        pool, filled, bad = [self.feed_bytes], len(self.feed_bytes), np.zeros(n, bool)

        def put(found: list[bytes], code: np.ndarray, where: np.ndarray, column: int) -> None:
            nonlocal filled
            sizes = np.fromiter(map(len, found), np.int64, len(found))
            start[where, column] = (np.cumsum(sizes) - sizes + filled)[code]
            size[where, column] = sizes[code]
            pool.extend(found)
            filled += int(sizes.sum())

        for lead, mine in (("", first), (" ", ~first)):
            coded = flat.filter(pa.array(mine)).dictionary_encode()
            where, code, known = np.flatnonzero(mine), np.asarray(coded.indices), coded.dictionary
            stems = pc.utf8_rtrim(known, characters=string.punctuation)
            letters = pc.utf8_is_alpha(stems)
            stem = pc.if_else(letters, stems, known).dictionary_encode()
            mark = pc.if_else(letters, pc.replace_substring_regex(known, _BEFORE_MARKS, ""), "").dictionary_encode()
            found, unsafe = self._ids_of(stem.dictionary, lead)
            of_stem = np.asarray(stem.indices)[code]
            put(found, of_stem, where, 0)
            put(self._mark_ids(mark.dictionary), np.asarray(mark.indices)[code], where, 1)
            bad[where] = unsafe[of_stem]
        # a line feed follows the last word of every line but a text's last
        per_line = np.diff(word_at)
        doc_of_line = np.repeat(np.arange(d), np.diff(line_at))
        place = 2 * np.arange(n) + np.repeat(np.arange(len(per_line)) - doc_of_line, per_line)
        items = 2 * n + len(per_line) - d
        starts, sizes = np.zeros(items, np.int32), np.full(items, len(self.feed_bytes), np.int32)
        for column in (0, 1):
            starts[place + column], sizes[place + column] = start[:, column], size[:, column]
        starts, sizes = starts // ID_BYTES, sizes // ID_BYTES
        del start, size, place
        ends = np.cumsum(sizes, dtype=np.int32)
        at = np.repeat(starts - ends + sizes, sizes)
        at += np.arange(len(at), dtype=np.int32)
        ids = np.frombuffer(b"".join(pool), "<u4")[at]
        item_at = 2 * word_at[line_at] + line_at - np.arange(d + 1)  # items before each text
        item_at[-1] = items
        at = np.concatenate([[0], ends])[item_at]
        if self.feed < 0 or bad.any():  # texts with other blanks are encoded again in another way
            odd = set(range(d)) if self.feed < 0 else set(doc_of_line[np.repeat(np.arange(len(per_line)), per_line)[bad]].tolist())
            parts = [np.frombuffer(self._whole(texts[k].as_py()), "<u4") if k in odd else ids[at[k]:at[k + 1]]
                     for k in range(d)]
            ids = np.concatenate(parts)
            at = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
        return ids, at

    def encode(self, texts: pa.Array | Iterable[str | None]) -> list[bytes]:
        """Ids of each text as little-endian uint32 bytes."""
        column = texts if isinstance(texts, pa.Array) else pa.array(list(texts), pa.string())
        if not len(column):
            return []
        if column.nbytes > CALL_BYTES and len(column) > 1:
            half = len(column) // 2
            return self.encode(column.slice(0, half)) + self.encode(column.slice(half))
        ids, at = self.encode_column(column)
        return [ids[a:b].tobytes() for a, b in zip(at, at[1:])]


_ENCODERS: dict[tuple[str, int], ChunkEncoder] = {}


def encoder(path: str, words_kept: int = 200_000) -> ChunkEncoder:
    """This worker's encoder for a tokenizer file; one at a time stays."""
    if (path, words_kept) not in _ENCODERS:
        pa.set_memory_pool(pa.system_memory_pool())  # gives large buffers back at once
        _ENCODERS.clear()
        _ENCODERS[path, words_kept] = ChunkEncoder(path, words_kept)
    return _ENCODERS[path, words_kept]


def release_memory() -> None:
    """Give a finished task's Arrow buffers back, as the worker process lives on."""
    pa.default_memory_pool().release_unused()
