"""Whole texts to token ids with the ``tokenizers`` library, each distinct word encoded once per worker.

Where a tokenizer's file shows that white space always ends a piece (its pre-tokenizer keeps matches of a pattern that
holds no white space, after NFC, white-space and lower-case steps), the ids of a text are the ids of its
white-space-separated words one after another.  Then words are looked up by a 64-bit hash in a bounded open-addressing
table; only words not yet seen go through the library, many at a time, parted by a NUL whose id marks the seams.
Any other tokenizer is applied to each whole text.
"""

from __future__ import annotations

import codecs
import json
import os
import re

import numpy as np

from quern.llm.textcore import KEPT, Words, chunks, text_buffers

_SLOTS_BITS = 21
_OPENED: dict[str, Encoder] = KEPT.setdefault("encoders", {})
#: Words of lower-case Latin letters, digits and ASCII marks without apostrophes; composed already, so NFC keeps them.
_PLAIN = re.compile("[!-&(-~\u00e0-\u00f6\u00f8-\u00ff\u0153\u0161\u017e]+")
_PIECES = re.compile("[a-z\u00e0-\u00f6\u00f8-\u00ff\u0153\u0161\u017e]+|[0-9]|[^a-z0-9\u00e0-\u00f6\u00f8-\u00ff\u0153\u0161\u017e]+")


def byte_letters() -> dict[int, str]:
    """Byte-level BPE's public rule: printable bytes stand for themselves, the others for 256, 257, ... in order."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return {b: chr(b if b in shown else next(rest)) for b in range(256)}


def word_bpe_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _flat(each: list[np.ndarray], dtype) -> tuple[np.ndarray, np.ndarray]:
    return np.concatenate([*each, np.zeros(0, dtype)]).astype(dtype), np.fromiter(map(len, each), np.int64, len(each))


def _splits_at_space(config: dict) -> bool:
    norm, pre = config.get("normalizer") or {}, config.get("pre_tokenizer") or {}
    steps = norm.get("normalizers", [norm] if norm else [])
    parts = pre.get("pretokenizers", [pre] if pre else [])
    fine = all(s.get("type") in ("NFC", "Lowercase") or s.get("type") == "Replace" and s.get("pattern") == {"Regex": "\\s+"} and s.get("content") == " " for s in steps)
    split = parts[:1] and parts[0].get("type") == "Split" and parts[0].get("invert") and parts[0].get("behavior") == "Removed" and parts[0]["pattern"].get("Regex", " ").endswith("[^\\s\\p{L}\\p{N}]+") and " " not in parts[0]["pattern"]["Regex"]
    rest = all(p.get("type") == "ByteLevel" and not p.get("add_prefix_space") and not p.get("use_regex") for p in parts[1:])
    added = all(not any(c.isspace() for c in a["content"]) and not a["lstrip"] and not a["rstrip"] and not a["single_word"] for a in config.get("added_tokens", []))
    return bool(fine and split and rest and added and not config.get("truncation") and not config.get("padding") and not config["model"].get("dropout"))


def encoder(path: str | None = None) -> Encoder:
    """This worker's encoder for a tokenizer file."""
    path = path or word_bpe_path()
    if path not in _OPENED:
        _OPENED[path] = Encoder(path)
    return _OPENED[path]


class Encoder:
    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            config = json.load(f)
        self.by_word = _splits_at_space(config)
        steps = (config.get("normalizer") or {}).get("normalizers", [])
        self.folds = any(s.get("type") == "Lowercase" for s in steps)
        self.marks = [a["content"].encode()[:2] for a in config.get("added_tokens", [])]
        top = max(self.library.get_vocab_size(), 1 + max(self.library.get_vocab().values()))
        self.dtype = np.uint16 if top <= 1 << 16 else np.uint32
        seam = self.library.encode("\x00", add_special_tokens=False).ids
        self.by_word &= len(seam) == 1
        self.seam = seam[0] if seam else -1
        self._bare(config)
        self._reset()

    def _bare(self, config: dict) -> None:
        """The same model behind a plain split at spaces: several times as fast for words whose pieces are plain to see."""
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import WhitespaceSplit

        end = config["model"].get("end_of_word_suffix")
        self.bare = None
        if self.by_word and self.folds and end and config["model"]["type"] == "BPE":
            self.bare = Tokenizer(self.library.model)
            self.bare.pre_tokenizer = WhitespaceSplit()
            vocab = config["model"]["vocab"]
            self.closes = np.zeros(max(vocab.values()) + 1, bool)
            self.closes[[i for t, i in vocab.items() if t.endswith(end)]] = True
            self.letters = "".join(c if b != 32 else " " for b, c in sorted(byte_letters().items()))

    def _plain_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all the words one after another, and each word's number of ids."""
        pieces = list(map(_PIECES.findall, words))
        line = " ".join([p for ps in pieces for p in ps])
        if not line.isascii():
            line = codecs.charmap_decode(line.encode("utf-8"), "strict", self.letters)[0]
        ids = np.array(self.bare.encode_batch_fast([line], add_special_tokens=False)[0].ids, np.int64)
        ends = np.flatnonzero(self.closes[ids]) + 1
        last = np.cumsum(np.fromiter(map(len, pieces), np.int64, len(pieces)))
        if not len(ends) or len(ends) != last[-1] or ends[-1] != len(ids):
            return _flat([self._whole(w.encode("utf-8")) for w in words], self.dtype)
        return ids.astype(self.dtype), np.diff(ends[last - 1], prepend=0)

    def _whole(self, word: bytes) -> np.ndarray:
        return np.array(self.library.encode(word.decode("utf-8"), add_special_tokens=False).ids, self.dtype)

    def _reset(self) -> None:
        self.keys = np.zeros(1 << _SLOTS_BITS, np.uint64)
        self.slot = np.zeros(1 << _SLOTS_BITS, np.int32)
        self.begin = np.zeros(1 << 16, np.int64)
        self.length = np.zeros(1 << 16, np.int32)
        self.pool = np.zeros(1 << 18, self.dtype)
        self.n, self.used = 0, 0

    def _find(self, h: np.ndarray) -> np.ndarray:
        """Entry of each hash, -1 where there is none."""
        mask = (1 << _SLOTS_BITS) - 1
        at = (h >> np.uint64(64 - _SLOTS_BITS)).astype(np.int64)
        key = self.keys[at]
        out = np.where(key == h, self.slot[at], -1)
        left = np.flatnonzero((key != h) & (key != 0))
        while len(left):
            at[left] = (at[left] + 1) & mask
            key = self.keys[at[left]]
            hit = key == h[left]
            out[left[hit]] = self.slot[at[left[hit]]]
            left = left[~hit & (key != 0)]
        return out

    def _insert(self, h: np.ndarray, ids: np.ndarray, sizes: np.ndarray) -> None:
        mask = (1 << _SLOTS_BITS) - 1
        n, used = self.n + len(sizes), self.used + len(ids)
        if n > len(self.begin):
            self.begin, self.length = (np.resize(x, 2 * n) for x in (self.begin, self.length))
        if used > len(self.pool):
            self.pool = np.resize(self.pool, 2 * used)
        self.pool[self.used : used] = ids
        self.begin[self.n : n] = self.used + np.cumsum(sizes) - sizes
        self.length[self.n : n] = sizes
        entry = np.arange(self.n, n, dtype=np.int32)
        at, left = (h >> np.uint64(64 - _SLOTS_BITS)).astype(np.int64), np.arange(len(h))
        while len(left):
            here = at[left]
            free = self.keys[here] == 0
            self.keys[here[free]] = h[left[free]]
            mine = self.keys[here] == h[left]
            self.slot[here[mine]] = entry[left[mine]]
            left = left[~mine]
            at[left] = (at[left] + 1) & mask
        self.n, self.used = n, used

    def _learn(self, h: np.ndarray, words: list[bytes]) -> None:
        """Encodes words and enters them under their hashes."""
        plain: list[int] = []
        if self.bare is not None:
            texts = b" ".join(words).decode("utf-8").lower().split(" ")
            plain = [k for k, t in enumerate(texts) if _PLAIN.fullmatch(t) and "<|" not in t] if len(texts) == len(words) else []
            for a in range(0, len(plain), 8192):
                part = plain[a : a + 8192]
                self._insert(h[part], *self._plain_words([texts[k] for k in part]))
        rest = np.setdiff1d(np.arange(len(words)), plain).tolist() if plain else range(len(words))
        for a in range(0, len(rest), 4096):
            part = list(rest[a : a + 4096])
            self._insert(h[part], *self._library_words([words[k] for k in part]))

    def _library_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        if not any(b"\x00" in w for w in words):
            text = b" \x00 ".join(words).decode("utf-8")
            ids = np.array(self.library.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.int64)
            seams = np.flatnonzero(ids == self.seam)
            if len(seams) == len(words) - 1:
                return ids[ids != self.seam].astype(self.dtype), np.diff(seams, prepend=-1, append=len(ids)) - 1
        return _flat(list(map(self._whole, words)), self.dtype)

    def _chunk(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all documents one after another, and n+1 offsets into them."""
        raw = data.tobytes()
        words = Words(data, offsets, fold=self.folds and not any(m in raw for m in self.marks))
        if not len(words.start):
            return np.zeros(0, self.dtype), np.zeros(len(offsets), np.int64)
        entry = self._find(words.hash)
        missing = np.flatnonzero(entry < 0)
        if len(missing):
            fresh, where = np.unique(words.hash[missing], return_index=True)
            if self.n and self.n + len(fresh) > 0.6 * (1 << _SLOTS_BITS):
                self._reset()
                missing = np.arange(len(entry))
                fresh, where = np.unique(words.hash, return_index=True)
            if len(fresh) > 0.6 * (1 << _SLOTS_BITS):
                raise ValueError("a chunk has more distinct words than the table's slots; use smaller chunks")
            spots = missing[where]
            self._learn(fresh, [raw[a:b] for a, b in zip(words.start[spots].tolist(), words.end[spots].tolist(), strict=True)])
            entry[missing] = self._find(words.hash[missing])
        sizes = self.length[entry].astype(np.int64)
        ends = np.concatenate(([0], np.cumsum(sizes)))
        ids = self.pool[np.repeat(self.begin[entry] - ends[:-1], sizes) + np.arange(ends[-1])]
        return ids, ends[words.first]

    def encode_column(self, column, end_id: int | None = None):
        """Yields (first row, ids, offsets) over parts of a text column; null is empty, ``end_id`` follows each text."""
        data, offsets = text_buffers(column)
        for a, b in chunks(offsets):
            part, off = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
            if self.by_word and b - a == 1 and len(part) > 1 << 23:
                ids, ends = self._long(part)
            elif self.by_word:
                ids, ends = self._chunk(part, off)
            else:
                texts = [part[x:y].tobytes().decode("utf-8") for x, y in zip(off[:-1], off[1:], strict=True)]
                each = [np.array(e.ids, self.dtype) for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]
                ids, ends = np.concatenate(each), np.concatenate(([0], np.cumsum([len(x) for x in each])))
            if end_id is not None:
                ids = np.insert(ids, ends[1:], end_id)
                ends = ends + np.arange(len(ends))
            yield a, ids, ends

    def _long(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One very long text, cut at white space into parts that fit the table."""
        raw, got, a = data.tobytes(), [], 0
        while a < len(raw):
            b = min(len(raw), a + (1 << 22))
            while b < len(raw) and raw[b : b + 1] not in b" \n\t\r\x0b\x0c":
                b += 1
            got.append(self._chunk(data[a:b], np.array([0, b - a]))[0])
            a = b
        ids = np.concatenate(got)
        return ids, np.array([0, len(ids)])
