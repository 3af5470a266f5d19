"""Token ids of whole texts by a public tokenizer file, with a memo of text pieces.

Both families of files cut a text before any merge rule is applied, and never let a token cross such a cut. So the ids of
a text are the ids of its pieces, and a piece met before needn't be encoded again. A text for which the cheap cut isn't
proven goes to the library whole; so does one that holds the content of an added token, in whatever case.
"""

from __future__ import annotations

import json
import os
import unicodedata

import numpy as np
import pyarrow as pa

from recollect.llm import common

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

# White space outside ASCII, on which libraries differ; by its first bytes, and ranges of its last one.
ODD_SPACE = [(b"\xc2", 0x85, 0x85), (b"\xc2", 0xA0, 0xA0), (b"\xe1\x9a", 0x80, 0x80), (b"\xe2\x80", 0x80, 0x8A), (b"\xe2\x80", 0xA8, 0xA9), (b"\xe2\x80", 0xAF, 0xAF), (b"\xe2\x81", 0x9F, 0x9F), (b"\xe3\x80", 0x80, 0x80)]
#: Bytes that send a text to the library: information separators; in a file whose white space belongs to tokens also all white
#: space but the space and the newline.
ODD = np.isin(np.arange(256), [28, 29, 30, 31])
ODD_SPACED = ODD | np.isin(np.arange(256), [9, 11, 12, 13])
ODD_LEAD = np.isin(np.arange(256), [b[0] for b, _, _ in ODD_SPACE])
PLAIN, AFTER_SPACE, AFTER_NEWLINE = range(3)


class Memo:
    """Pieces met before: an open-addressed table of (hash, check) -> place of the ids in a pool. `check` is the piece's first
    8 bytes mixed with its last 8, so a piece of 16 bytes at most is found by all its bytes, a longer one by 128 bits."""

    def __init__(self, slots: int = 1 << 16):
        self.bits = slots.bit_length() - 1
        self.hash, self.check = np.zeros(slots, np.uint64), np.zeros(slots, np.uint64)
        self.begin, self.length = np.zeros(slots, np.int32), np.zeros(slots, np.int32)
        self.pool, self.used, self.n = np.zeros(1 << 16, np.uint32), 0, 0

    def grow(self, slots: int) -> None:
        old = np.flatnonzero(self.hash)
        kept = self.hash[old], self.check[old], self.begin[old], self.length[old]
        pool, used = self.pool, self.used
        self.__init__(slots)
        out = self.place(*kept[:2])
        self.begin[out], self.length[out] = kept[2:]
        self.pool, self.used, self.n = pool, used, len(old)

    def find(self, h: np.ndarray, check: np.ndarray) -> np.ndarray:
        """Slots of the pieces, -1 for unknown ones."""
        out = np.full(len(h), -1, np.int64)
        live, slot, mask = np.arange(len(h)), (h >> np.uint64(64 - self.bits)).astype(np.int64), (1 << self.bits) - 1
        while len(live):
            there = self.hash[slot]
            hit = (there == h[live]) & (self.check[slot] == check[live])
            out[live[hit]] = slot[hit]
            on = ~hit & (there != 0)
            live, slot = live[on], (slot[on] + 1) & mask
        return out

    def place(self, h: np.ndarray, check: np.ndarray) -> np.ndarray:
        """New slots of distinct unknown pieces."""
        out = np.empty(len(h), np.int64)
        live, slot, mask = np.arange(len(h)), (h >> np.uint64(64 - self.bits)).astype(np.int64), (1 << self.bits) - 1
        while len(live):
            free = np.flatnonzero(self.hash[slot] == 0)
            claim, first = np.unique(slot[free], return_index=True)  # one piece a free slot
            won = free[first]
            out[live[won]] = claim
            self.hash[claim], self.check[claim] = h[live[won]], check[live[won]]
            left = np.ones(len(live), bool)
            left[won] = False
            live, slot = live[left], (slot[left] + 1) & mask
        return out

    def add(self, h: np.ndarray, check: np.ndarray, ids: np.ndarray, counts: np.ndarray) -> None:
        """Stores distinct unknown pieces."""
        slots = len(self.hash)
        while 10 * (self.n + len(h)) > 7 * slots:
            slots *= 2
        if slots > len(self.hash):
            self.grow(slots)
        size = self.used + len(ids)
        if size > len(self.pool):
            self.pool = np.concatenate((self.pool, np.zeros(max(size - len(self.pool), len(self.pool) >> 1), np.uint32)))
        self.pool[self.used : size] = ids
        out = self.place(h, check)
        self.begin[out], self.length[out] = self.used + np.cumsum(counts) - counts, counts
        self.used, self.n = size, self.n + len(h)


class Encoder:
    """ids(texts) gives each text's ids as little-endian unsigned 32-bit integers.

    A batch is cut and hashed as bytes; pieces that the memo has cost no Python object. New pieces are encoded many at a time, in
    one string, and parted again by the bytes that each id stands for. At `limit` pieces the memo starts anew."""

    limit, together = 1_000_000, 400

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path) as f:
            spec = json.load(f)
        self.cut = self.kind(spec)
        self.added = [t["content"].lower().encode() for t in spec.get("added_tokens") or []]
        if any(not t.isascii() or not t or any(c in b" \t\n\r\f\v;`" for c in t) for t in self.added):
            self.cut = "whole"  # white space lies in it, or the normaliser can make it of other characters
        self.lower = "Lowercase" in json.dumps(spec.get("normalizer"))
        vocab = self.tokenizer.get_vocab()
        end = spec["model"].get("end_of_word_suffix") or ""
        self.bytes_of = np.zeros(max(vocab.values()) + 1, np.int64)
        for token, i in vocab.items():
            self.bytes_of[i] = len(token.removesuffix(end) if end else token)
        self.forget()

    def forget(self) -> None:
        self.memo = Memo()

    @staticmethod
    def kind(spec: dict) -> str:
        pre = spec.get("pre_tokenizer") or {}
        if pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and not spec.get("normalizer"):
            return "spaced"  # white space belongs to the token after it
        steps = pre.get("pretokenizers") or [{}]
        if steps[0].get("type") == "Split" and steps[0].get("behavior") == "Removed" and steps[0].get("invert") and "\\s" in str(steps[0].get("pattern")):
            return "dropped"  # white space is no part of any token
        return "whole"

    def uncut(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """True for texts whose pieces aren't known to encode alone as they do in the text."""
        if self.cut == "whole":
            return np.ones(len(offsets) - 1, bool)
        spaced = self.cut == "spaced"
        odd = (ODD_SPACED if spaced else ODD)[data]
        leads = np.flatnonzero(ODD_LEAD[data])
        for before, low, high in ODD_SPACE:
            at = leads[leads + len(before) < len(data)]
            for k, byte in enumerate(before):
                at = at[data[at + k] == byte]
            last = data[at + len(before)]
            odd[at[(last >= low) & (last <= high)]] = True
        if spaced:  # the pattern looks over a cut beside more white space, and white space at an end stands alone
            space = common.SPACE[data]
            odd[1:] |= space[1:] & space[:-1]
            some = np.flatnonzero(offsets[1:] > offsets[:-1])
            first, last = offsets[some], offsets[some + 1] - 1
            odd[first] |= space[first]
            odd[last] |= space[last]
        places = [np.flatnonzero(odd)]
        if self.added:
            raw = data.tobytes().lower()
            for token in self.added:
                at = raw.find(token)
                while at >= 0:
                    places.append(np.array([at]))
                    at = raw.find(token, int(offsets[np.searchsorted(offsets, at, "right")]))  # on in the next text
        out = np.zeros(len(offsets) - 1, bool)
        out[np.searchsorted(offsets, np.concatenate(places), "right") - 1] = True
        return out

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode_pieces(self, plain: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of pieces that come after white space, and how many each has."""
        if self.cut == "dropped":
            sizes = [len(p if p.isascii() else unicodedata.normalize("NFC", p).lower().encode()) for p in plain]
        else:
            sizes = [len(p.encode()) for p in plain]
        groups = [slice(i, i + self.together) for i in range(0, len(plain), self.together)]
        made, counts = [], []
        for g, ids in zip(groups, self.encode([(" " if self.cut == "dropped" else "").join(plain[g]) for g in groups]), strict=True):
            ends, want = np.cumsum(self.bytes_of[ids]), np.cumsum(sizes[g])
            at = np.searchsorted(ends, want)
            if len(ends) and ends[-1] == want[-1] and np.array_equal(ends[np.minimum(at, len(ends) - 1)], want):
                made.append(ids)
                counts.append(np.diff(at + 1, prepend=0))
            else:  # a form that the normaliser changes in length
                alone = self.encode(plain[g])
                made += alone
                counts.append(np.array([len(x) for x in alone]))
        return np.concatenate(made), np.concatenate(counts)

    def learn(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, kind: np.ndarray, h: np.ndarray, check: np.ndarray) -> None:
        """Encodes unknown pieces, each once."""
        _, first = np.unique(h ^ common.finish(check), return_index=True)
        raw = data.tobytes()
        for alone in (False, True):  # no white space parts pieces at the start of a text
            of = first[(kind[first] == PLAIN) == alone] if self.cut == "spaced" else first[: 0 if alone else None]
            if len(of):
                texts = [raw[a:b].decode() for a, b in zip(start[of].tolist(), end[of].tolist(), strict=True)]
                if self.cut == "spaced" and not alone:
                    texts = [("\n" if k == AFTER_NEWLINE else " ") + t for k, t in zip(kind[of].tolist(), texts, strict=True)]
                if alone:
                    made = self.encode(texts)
                    ids, counts = np.concatenate(made), np.array([len(x) for x in made])
                else:
                    ids, counts = self.encode_pieces(texts)
                self.memo.add(h[of], check[of], ids, counts)

    def ids(self, texts: list[str] | pa.Array) -> list[bytes]:
        """Ids of each text; null is empty."""
        col = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string())
        data, offsets = common.text_buffer(col)
        whole = self.uncut(data, offsets)
        alone = np.flatnonzero(whole & (offsets[1:] > offsets[:-1])).tolist()
        long = [data[offsets[i] : offsets[i + 1]].tobytes().decode() for i in alone]
        made = dict(zip(alone, self.encode(long), strict=True)) if alone else {}
        if self.cut == "dropped" and self.lower:
            data = common.LOWER[data]  # A-Z first: it commutes with the normaliser's own steps
        found = common.Words(pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))))
        taken = np.repeat(~whole, found.count())
        start, end, h = found.start[taken], found.end[taken], found.hashes[taken]
        counts = np.where(whole, 0, found.count())
        kind = np.zeros(len(start), np.int64)
        if self.cut == "spaced":
            kind = np.where(data[start - 1] == 10, AFTER_NEWLINE, AFTER_SPACE)
            kind[(np.cumsum(counts) - counts)[counts > 0]] = PLAIN
            h = common.finish(h + kind.astype(np.uint64) * common.MIX[3])
        blocks, size = common.byte_blocks(data), end - start
        low = common.LOW_BYTES[np.minimum(size, 8)]
        check = common.finish(blocks[start] & low) + (blocks[np.maximum(end - 8, start)] & low) * common.MIX[4] + size.astype(np.uint64)
        h = np.maximum(h, np.uint64(1))  # 0 marks a free slot
        slot = self.memo.find(h, check)
        if self.memo.n > self.limit and (slot < 0).any():
            self.forget()
            slot = self.memo.find(h, check)
        while (new := np.flatnonzero(slot < 0)).size:
            slots = self.memo.bits
            self.learn(data, start[new], end[new], kind[new], h[new], check[new])
            again = new if self.memo.bits == slots else np.arange(len(slot))  # a table that grew has moved all pieces
            slot[again] = self.memo.find(h[again], check[again])
        begin, length = self.memo.begin[slot].astype(np.int64), self.memo.length[slot]
        ends = np.cumsum(length, dtype=np.int64)
        flat = self.memo.pool[np.repeat(begin - (ends - length), length) + np.arange(int(ends[-1]) if len(ends) else 0)]
        bounds = np.concatenate(([0], ends))[np.cumsum([0, *counts])].tolist()
        return [made[i].tobytes() if i in made else flat[a:b].tobytes() for i, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True))]


_loaded: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder a Python worker and file."""
    if path not in _loaded:
        _loaded[path] = Encoder(path)
    return _loaded[path]
