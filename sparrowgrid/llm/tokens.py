"""Token ids by the ``tokenizers`` library, encoded once for each distinct piece of text.

Both supported vocabularies split a text at white space before they look at anything else, so a text's ids
are those of its pieces in order. A piece is a word, with the white space before it where white space has ids: a token
may begin with a blank, but none spans the border from a non-space to a space. A process keeps a bounded table from
64-bit hashes of pieces to their ids and bytes; words repeat, and the library then sees each of them once, many in a call. A piece whose
bytes differ from those kept under its hash doesn't use the table's ids.
Scanning, hashing, looking up and putting together are array operations on whole batches.

Where another white space character than ASCII's stands before an ASCII one, the split is not proven, and such a
text is one piece; so is a text with the string of an added token, which the library looks for before it splits. Ids are kept as little-endian unsigned 16-bit integers: both vocabularies have fewer than 65,536
entries.
"""

from __future__ import annotations

import functools
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from . import wordkernel as wk

#: About 30 bytes each, and as much again while new ones are added.
TABLE_PIECES = 2_000_000
RUN_BYTES = 2 << 20
END_OF_WORD, BYTE_LEVEL = "end_of_word", "byte_level"
_TOGETHER = 512
_WIDE_SPACE = rb"(?:\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80)"
_UNPROVEN = re.compile(_WIDE_SPACE + rb"[\x09-\x0d ]")
_ANY_WIDE = re.compile(_WIDE_SPACE)


class PieceEncoder:
    """A vocabulary's encoder. ``style`` END_OF_WORD: white space has no ids. BYTE_LEVEL: it has."""

    def __init__(self, path: str, style: str):
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        if self._tokenizer.get_vocab_size() > 1 << 16:
            raise ValueError("ids of this vocabulary need more than 16 bits")
        self._style = style
        # In any case of letters, as a normaliser may lower them first.
        added = [re.escape(x.content.encode()) for x in self._tokenizer.get_added_tokens_decoder().values()]
        self._added = re.compile(b"|".join(added) or rb"(?!)", re.IGNORECASE)
        size = np.zeros(1 << 16, np.int64)
        for token, k in self._tokenizer.get_vocab(with_added_tokens=False).items():
            size[k] = len(token.removesuffix("</w>") if style == END_OF_WORD else token)  # a character for each byte
        self._bytes = size
        self._clear()

    def _clear(self) -> None:
        self._keys, self._slots = np.empty(0, np.uint64), np.empty(0, np.int64)
        self._start, self._length, self._pool = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, "<u2")
        self._from, self._size, self._text = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint8)

    def _alone(self, pieces: list[bytes]) -> list[np.ndarray]:
        return [np.array(code.ids, "<u2") for code in self._tokenizer.encode_batch_fast([p.decode() for p in pieces], add_special_tokens=False)]

    def _learn(self, pieces: list[bytes]) -> list[np.ndarray]:
        """The ids of each piece. Many pieces go into one call; where a piece's ids end follows from the bytes that each id
        stands for. Pieces that could merge with a neighbour are encoded alone."""
        plain = [k for k, p in enumerate(pieces) if not self._added.search(p)]
        out: list[np.ndarray | None] = [None] * len(pieces)
        if self._style == BYTE_LEVEL:
            space = b" \t\n\v\f\r"
            plain = [k for k in plain if pieces[k][:1] in space and pieces[k][-1:] not in space]
        groups, texts, sizes = [], [], []
        for k in range(0, len(plain), _TOGETHER):
            some = plain[k : k + _TOGETHER]
            own = [pieces[j] for j in some]
            if self._style == END_OF_WORD:
                text = b" ".join(own).decode()
                parts = self._tokenizer.normalizer.normalize_str(text).split(" ")
                own = [p.encode() for p in parts]
            else:
                raw = b"".join(own)
                if _ANY_WIDE.search(raw):
                    continue
                text = raw.decode()
            if len(own) == len(some):
                groups.append(some)
                texts.append(text)
                sizes.append(list(map(len, own)))
        for some, own, code in zip(groups, sizes, self._tokenizer.encode_batch_fast(texts, add_special_tokens=False), strict=True):
            ids = np.array(code.ids, "<u2")
            ends, total = np.cumsum(own), np.concatenate([[0], np.cumsum(self._bytes[ids])])
            cut = np.searchsorted(total, ends)
            if total[-1] == ends[-1] and (total[cut] == ends).all():
                for j, a, b in zip(some, [0, *cut[:-1].tolist()], cut.tolist(), strict=True):
                    out[j] = ids[a:b]
        rest = [j for j, x in enumerate(out) if x is None]
        for j, ids in zip(rest, self._alone([pieces[j] for j in rest]), strict=True):
            out[j] = ids
        return out

    def _store(self, pieces: list[bytes]) -> np.ndarray:
        """The slots of new pieces."""
        ids = self._learn(pieces)
        base, length, size = len(self._start), np.array(list(map(len, ids)), np.int64), np.array(list(map(len, pieces)), np.int64)
        self._start = np.concatenate([self._start, len(self._pool) + np.cumsum(length) - length])
        self._length = np.concatenate([self._length, length])
        self._pool = np.concatenate([self._pool, *ids])
        self._from = np.concatenate([self._from, len(self._text) + np.cumsum(size) - size])
        self._size = np.concatenate([self._size, size])
        self._text = np.concatenate([self._text, np.frombuffer(b"".join(pieces), np.uint8)])
        return base + np.arange(len(pieces))

    def _slots_of(self, hashes: np.ndarray, start: np.ndarray, end: np.ndarray, raw: bytes) -> np.ndarray:
        """Each piece's slot in the table; new pieces get one."""
        distinct, at, where = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self._keys) + len(distinct) > TABLE_PIECES:
            self._clear()
        place = np.searchsorted(self._keys, distinct)
        new = np.ones(len(distinct), bool)
        inside = place < len(self._keys)
        new[inside] = self._keys[place[inside]] != distinct[inside]
        if new.any():
            some = at[new]
            slots = self._store([raw[a:b] for a, b in zip(start[some].tolist(), end[some].tolist(), strict=True)])
            self._slots = np.insert(self._slots, place[new], slots)
            self._keys = np.insert(self._keys, place[new], distinct[new])
            place = np.searchsorted(self._keys, distinct)
        slot = self._slots[place][where]
        odd = np.flatnonzero(self._differs(slot, start, end, np.frombuffer(raw, np.uint8)))
        if len(odd):  # two pieces of one hash
            texts = [raw[a:b] for a, b in zip(start[odd].tolist(), end[odd].tolist(), strict=True)]
            known = {t: k for k, t in enumerate(dict.fromkeys(texts))}
            slot[odd] = self._store(list(known))[[known[t] for t in texts]]
        return slot

    def _differs(self, slot: np.ndarray, start: np.ndarray, end: np.ndarray, data: np.ndarray) -> np.ndarray:
        """Whether pieces have other bytes than those kept in their slots."""
        size = end - start
        out = self._size[slot] != size
        own = np.flatnonzero(~out & (size > wk.EXACT))  # shorter ones of one length have hashes of their own
        if len(own):
            ends = np.cumsum(size[own])
            inner = np.arange(int(ends[-1])) - np.repeat(ends - size[own], size[own])
            same = data[np.repeat(start[own], size[own]) + inner] == self._text[np.repeat(self._from[slot[own]], size[own]) + inner]
            out[own] = ~np.logical_and.reduceat(same, ends - size[own])
        return out

    def _pieces(self, words: wk.Words, raw: bytes) -> tuple[np.ndarray, ...]:
        """(first piece of each text, start, end, hash) of a run of texts."""
        hits = [m.start() for m in self._added.finditer(raw)]
        if self._style == END_OF_WORD and not hits:
            return words.first, words.start, words.end, words.hash
        n = len(words.offsets) - 1
        text = words.text_of()
        start, end = words.start, words.end
        more_text = more_start = more_end = np.empty(0, np.int64)
        if self._style == BYTE_LEVEL:
            start = np.empty_like(words.start)
            start[1:] = words.end[:-1]
            opens = words.first[:-1][words.counts > 0]
            start[opens] = words.offsets[:-1][words.counts > 0]
            # White space behind the last word is a piece of its own; a text whose split is not proven is one piece.
            last = words.offsets[:-1].copy()
            last[words.counts > 0] = words.end[words.first[1:][words.counts > 0] - 1]
            more_text = np.flatnonzero(words.offsets[1:] > last)
            more_start, more_end = last[more_text], words.offsets[1:][more_text]
            hits += [m.start() for m in _UNPROVEN.finditer(raw)]
        odd = np.unique(np.searchsorted(words.offsets, np.array(hits, np.int64), "right") - 1).astype(np.int64)
        if len(odd):
            stays, more_stays = ~np.isin(text, odd), ~np.isin(more_text, odd)
            text, start, end = text[stays], start[stays], end[stays]
            more_text = np.concatenate([more_text[more_stays], odd])
            more_start, more_end = np.concatenate([more_start[more_stays], words.offsets[odd]]), np.concatenate([more_end[more_stays], words.offsets[odd + 1]])
        if len(more_text):
            text, start, end = np.concatenate([text, more_text]), np.concatenate([start, more_start]), np.concatenate([end, more_end])
            order = np.lexsort((start, text))
            text, start, end = text[order], start[order], end[order]
        return np.searchsorted(text, np.arange(n + 1)), start, end, words.hash_of(start, end)

    def encode(self, column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(first text, end text, ids of these texts, where each text's begin and the last's end) of bounded runs of a string column; null is empty."""
        data, offsets = wk.string_buffers(column)
        for low, high in wk.runs(offsets, RUN_BYTES):
            own = offsets[low : high + 1]
            words = wk.scan(np.ascontiguousarray(data[own[0] : own[-1]]), own - own[0], lower=False)
            raw = words.data.tobytes()
            first, start, end, hashes = self._pieces(words, raw)
            slot = self._slots_of(hashes, start, end, raw)
            length = self._length[slot]
            ends = np.zeros(len(slot) + 1, np.int64)
            np.cumsum(length, out=ends[1:])
            ids = self._pool[np.repeat(self._start[slot] - ends[:-1], length) + np.arange(ends[-1])]
            yield low, high, ids, ends[first]


@functools.cache
def encoder(name: str, style: str) -> PieceEncoder:
    """A process's encoder of one public vocabulary file."""
    import public_tokenizers

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    return PieceEncoder(name if "/" in name else public_tokenizers.path(name), style)
