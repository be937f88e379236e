"""Byte-level BPE encoding of whole texts with the tokenizers library, remembered per pre-token.

The library's byte-level pre-tokenizer never joins characters over its boundaries, so
a text's ids are its pre-tokens' ids in order. Boundaries are found for a whole Arrow
chunk at once; each distinct pre-token is merged by the library once per worker and
then looked up: a hash says where, its bytes whether it is the same. Texts whose
characters the vectorised rule doesn't know (apostrophes, non-letters beyond ASCII) get
their boundaries from the pattern itself. Added tokens (special ones among them) inside
a text part it and get their own ids, as in the library's ``encode``.
"""

from __future__ import annotations

import re
from functools import lru_cache
from itertools import chain

import numpy as np
import regex
from tokenizers import Tokenizer, models, pre_tokenizers

from siltstone.llm import spans

# Fixed value: the public byte-level pre-tokenizer's pattern.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_LETTER, _DIGIT, _SPACE, _OTHER = range(4)
#: Longest pre-token in bytes that a worker remembers; longer ones are merged anew in each chunk.
KEPT_BYTES = 64


def _classes() -> np.ndarray:
    table = np.full(256, _OTHER, np.uint8)
    table[0x41:0x5B] = table[0x61:0x7B] = table[0x80:] = _LETTER
    table[0x30:0x3A] = _DIGIT
    table[[0x20, *range(0x09, 0x0E)]] = _SPACE
    return table


def _unknown() -> np.ndarray:
    """Bytes after which a text needs the pattern: the apostrophe, and lead bytes other than those of
    Latin (U+00C0-U+024F) and basic Cyrillic letters."""
    table = np.zeros(256, bool)
    table[0xC0:] = True
    table[[*range(0xC3, 0xCA), 0xD0, 0xD1]] = False
    table[0x27] = True
    return table


def _byte_characters() -> dict[int, str]:
    """Byte-level alphabet: printable Latin-1 bytes stand for themselves, others follow from U+0100 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = (b for b in range(256) if b not in shown)
    return {b: chr(b) for b in shown} | {b: chr(0x100 + i) for i, b in enumerate(hidden)}


class ByteBpe:
    def __init__(self, path: str, end_id: int | None, bits: int = 21) -> None:
        tokenizer = Tokenizer.from_file(path)
        pre, self.model = tokenizer.pre_tokenizer, tokenizer.model
        plain = isinstance(pre, pre_tokenizers.ByteLevel) and pre.use_regex and not pre.add_prefix_space
        if not plain or tokenizer.normalizer or not isinstance(self.model, models.BPE) or self.model.ignore_merges:
            raise ValueError("a byte-level BPE tokenizer without normalizer or prefix space is needed")
        added = tokenizer.get_added_tokens_decoder()
        if any(t.single_word or t.lstrip or t.rstrip for t in added.values()):
            raise ValueError("added tokens that take white space or whole words only aren't known")
        self.pattern = regex.compile(PATTERN)
        self.added = {t.content.encode(): i for i, t in added.items()}
        self.marks = re.compile(b"|".join(re.escape(t) for t in sorted(self.added, key=len, reverse=True)))
        self.known = spans.Interner(bits)
        self.pool, self.used = np.zeros(1 << 20, np.uint32), 0
        self.text, self.text_used = np.zeros(1 << 20, np.uint8), 0
        # of each remembered pre-token: where its ids and bytes are, and how many
        self.at, self.text_at = (np.zeros(self.known.most, np.int32) for _ in range(2))
        self.count, self.text_size = (np.zeros(self.known.most, np.uint8) for _ in range(2))
        self.end = np.array([] if end_id is None else [end_id], np.uint32)
        self.characters = _byte_characters()
        self.classes, self.unknown = _classes(), _unknown()

    def _added_places(self, raw: bytes, offsets: np.ndarray) -> list[tuple[int, int, int]]:
        """(first byte, end, id) of added tokens, leftmost first, the longest of those at one place."""
        texts = set()
        for content in self.added:
            at = raw.find(content)
            while at >= 0:
                texts.add(int(np.searchsorted(offsets, at, "right")) - 1)
                at = raw.find(content, at + 1)
        out = []
        for i in sorted(texts):
            low = int(offsets[i])
            out += [(low + m.start(), low + m.end(), self.added[m[0]]) for m in self.marks.finditer(raw[low : int(offsets[i + 1])])]
        return out

    def boundaries(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """First bytes of all pre-tokens."""
        n, kind = len(data), self.classes[data]
        begins = np.zeros(n + 1, bool)
        begins[1:n] = kind[1:] != kind[:-1]
        begins[offsets] = True
        fresh = np.zeros(n + 1, bool)
        fresh[offsets] = True
        after = np.flatnonzero(begins[1:n] & ~fresh[1:n] & (kind[:-1] == _SPACE)) + 1
        begins[after[data[after - 1] == 0x20]] = False
        begins[after - 1] = True
        odd = np.flatnonzero(self.unknown[data])
        pair = np.flatnonzero((data[1:] == 0x97) | (data[1:] == 0xB7))
        odd = np.concatenate([odd, pair[data[pair] == 0xC3]])
        for i in np.unique(np.searchsorted(offsets, odd, "right") - 1):
            low, high = offsets[i], offsets[i + 1]
            lengths = [len(x.encode()) for x in self.pattern.findall(data[low:high].tobytes().decode())]
            begins[low:high] = False
            begins[low + np.cumsum([0, *lengths[:-1]])] = True
        return np.flatnonzero(begins[:n])

    def _merged(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        table, merge = self.characters, self.model.tokenize
        ids = [[t.id for t in merge(w.decode("latin1").translate(table))] for w in words]
        counts = np.fromiter(map(len, ids), np.int64, len(ids))
        return np.fromiter(chain.from_iterable(ids), np.uint32, int(counts.sum())), counts

    def _remember(self, keys: np.ndarray, ids: np.ndarray, counts: np.ndarray, words: list[bytes]) -> int:
        """Keep distinct new pre-tokens as far as there is room; how many were kept."""
        base, room = self.known.size, self.known.add(keys)
        n, text = int(counts[:room].sum()), b"".join(words[:room])
        sizes = np.fromiter(map(len, words[:room]), np.int64, room)
        for name, used, more in (("pool", self.used, n), ("text", self.text_used, len(text))):
            have = getattr(self, name)
            if used + more > len(have):
                setattr(self, name, np.concatenate([have, np.zeros(max(len(have), more), have.dtype)]))
        self.pool[self.used : self.used + n] = ids[:n]
        self.text[self.text_used : self.text_used + len(text)] = np.frombuffer(text, np.uint8)
        mine = slice(base, base + room)
        self.at[mine], self.count[mine] = self.used + np.cumsum(counts[:room]) - counts[:room], counts[:room]
        self.text_at[mine], self.text_size[mine] = self.text_used + np.cumsum(sizes) - sizes, sizes
        self.used, self.text_used = self.used + n, self.text_used + len(text)
        return room

    def _same(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, number: np.ndarray) -> np.ndarray:
        """Whether remembered pre-tokens have these very bytes."""
        same = self.text_size[number] == sizes
        at = np.flatnonzero(same)
        n = sizes[at]
        total = np.cumsum(n)
        step = np.arange(int(total[-1]) if len(total) else 0, dtype=np.int32)
        mine = data[np.repeat((starts[at] - total + n).astype(np.int32), n) + step]
        differ = mine != self.text[np.repeat((self.text_at[number[at]] - total + n).astype(np.int32), n) + step]
        if differ.any():
            same[at[np.searchsorted(total, np.flatnonzero(differ), "right")]] = False
        return same

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, each with the end id; where each text's ids begin."""
        raw = data.tobytes()
        marks = self._added_places(raw, offsets)
        cuts = np.sort(np.concatenate([offsets, *([a, b] for a, b, _ in marks)])) if marks else offsets
        starts = self.boundaries(data, cuts)
        if marks:
            first, last = (np.array([m[i] for m in marks]) for i in (0, 1))
            before = np.searchsorted(first, starts, "right") - 1
            starts = starts[(before < 0) | (starts >= last[before]) | (starts == first[before])]
        ends = np.append(starts[1:], len(data))
        sizes = ends - starts
        keys = spans.hash_spans(data, starts, ends)
        number = self.known.find(keys)
        seen = np.flatnonzero(number >= 0)
        number[seen[~self._same(data, starts[seen], sizes[seen], number[seen])]] = -1
        at, count = self.at[number].astype(np.int64), self.count[number].astype(np.int64)
        missing = np.flatnonzero(number < 0)
        pools = [self.end]
        if len(missing):
            # distinct by their bytes: equal hashes of different pre-tokens stay apart
            place: dict[bytes, int] = {}
            own = np.fromiter((place.setdefault(raw[a:b], len(place)) for a, b in zip(starts[missing].tolist(), ends[missing].tolist(), strict=True)), np.int64, len(missing))
            words = list(place)
            ids, counts = self._merged(words)
            begin = np.cumsum(counts) - counts
            at[missing], count[missing] = -1 - len(self.end) - begin[own], counts[own]
            pools.append(ids)
            nth = missing[np.unique(own, return_index=True)[1]]
            fresh = keys[nth]
            once = np.unique(fresh, return_index=True)[1]  # of colliding ones the first
            once = once[(sizes[nth[once]] <= KEPT_BYTES) & (self.known.find(fresh[once]) < 0)]
            upto = np.cumsum(counts[once])
            took = ids[np.repeat(begin[once] + counts[once] - upto, counts[once]) + np.arange(int(upto[-1]) if len(upto) else 0)]
            self._remember(fresh[once], took, counts[once], [words[i] for i in once.tolist()])
        pool = self.pool[: self.used]
        if marks:
            mine = np.searchsorted(starts, first)
            at[mine], count[mine] = -1 - sum(map(len, pools)) - np.arange(len(marks)), 1
            pools.append(np.array([i for _, _, i in marks], np.uint32))
        at = np.where(at < 0, self.used - 1 - at, at)  # what only this chunk knows follows the pool
        bound = np.searchsorted(starts, offsets)
        if len(self.end):
            at, count = np.insert(at, bound[1:], self.used), np.insert(count, bound[1:], 1)
            bound = bound + np.arange(len(bound))
        pool = np.concatenate([pool, *pools])
        total = np.concatenate([[0], np.cumsum(count)])
        take = np.repeat(at - total[:-1], count) + np.arange(total[-1])
        return pool[take], total[bound]


@lru_cache(maxsize=2)
def tokenizer(path: str, end_id: int | None) -> ByteBpe:
    """One per Python worker; it holds at most a million pre-tokens."""
    return ByteBpe(path, end_id)
