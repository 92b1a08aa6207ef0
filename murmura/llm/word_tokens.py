"""Token ids of whole texts by the ``tokenizers`` library, with a bounded cache of white-space separated chunks.

No pattern of the tokenizer family used here crosses white space, so a text's ids are those of its chunks, in order.
Chunks are kept as little-endian 16-bit ids (32-bit for larger vocabularies). Many texts are encoded at once: their chunks,
parted once more where punctuation follows letters, are numbered by Arrow, and each different one is looked up once. A text
that holds the string of an added token (``<|endoftext|>``, say), which the library finds before anything else, is encoded
whole by the library.
"""

from __future__ import annotations

import json
from unicodedata import normalize

import numpy as np
import pyarrow as pa

from .common import keeps, make_room

#: Chunks of more characters (text without white space, say) aren't kept.
LONG = 64
#: Characters a generation of the cache may hold for each chunk of its limit.
MEAN = 16
#: ASCII punctuation that the split pattern keeps as one piece after a word (the apostrophe starts other rules).
TAIL = '.,;:!?"#$%&()*+-/@[]^_`{|}~'
#: What parts chunks; by bytes of UTF-8: what a tail is of, and what is neither a space nor, perhaps, of a letter.
SPACES = bytes.maketrans(b"\n\t\r", b"   ")
IS_TAIL = np.isin(np.arange(256), np.frombuffer(TAIL.encode(), np.uint8))
IS_OTHER = np.array([b < 128 and b != 32 and not chr(b).isalpha() for b in range(256)])
#: Longer tails aren't looked for in bytes.
LONG_TAIL = 8


def _byte_alphabet() -> dict[int, int]:
    """The printable character that stands for each byte: itself if it is visible, else the next from 256 on."""
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in seen]
    return {b: b for b in seen} | {b: 256 + i for i, b in enumerate(rest)} | {32: 32}


BYTES = _byte_alphabet()


def _word(chunk: str) -> bool:
    """Letters only, before and after normalisation (which can part a mark from its letter)."""
    return chunk.isalpha() and "\u03a3" not in chunk and (chunk.isascii() or normalize("NFC", chunk).lower().isalpha())


class ChunkTokenizer:
    """Ids of texts, as the library gives them without special tokens of its own.

    The cache has two generations of at most ``limit`` chunks of at most ``LONG`` characters, ``MEAN`` times ``limit``
    characters in all (a chunk costs about 200 bytes and 12 a character at most, so a generation is bounded in bytes): when
    the young one is full it becomes the old one, from which chunks that are met again are taken back."""

    def __init__(self, path: str, limit: int = 300_000):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        added = self.tok.get_added_tokens_decoder().values()
        self.marks = sorted({m for t in added for m in (t.content, t.content.lower())})
        #: only marks that are looked for in the text as it stands leave the chunks independent of each other
        self.parts = not any(t.normalized or t.lstrip or t.rstrip or t.single_word for t in added)
        self.dtype = np.dtype("<u2" if self.tok.get_vocab_size() <= 65536 else "<u4")
        self.limit = limit
        self.plain = self._merges_only()
        self.lowers = self.tok.normalizer is not None and self.tok.normalizer.normalize_str("Ab") == "ab"
        self.cache: dict[str, bytes] = {"": b""}
        self.old: dict[str, bytes] = {}
        self.held = 0
        self.ends = np.zeros(self.tok.get_vocab_size(), bool)
        for piece, i in self.tok.get_vocab().items():
            self.ends[i] = piece.endswith("</w>")

    def _merges_only(self):
        """The same vocabulary without normaliser and pattern, if those are the ones known to leave lower-case words alone."""
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        setup = json.loads(self.tok.to_str())
        kinds = [[x["type"] for x in (setup[k] or {}).get(k + "s" if k == "normalizer" else "pretokenizers", [])] for k in ("normalizer", "pre_tokenizer")]
        if kinds != [["NFC", "Replace", "Lowercase"], ["Split", "ByteLevel"]]:
            return None
        plain = Tokenizer.from_str(self.tok.to_str())
        plain.normalizer = normalizers.Sequence([])
        plain.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        return plain

    def _raw(self, ids) -> bytes:
        return np.array(ids, self.dtype).tobytes()

    def _letters(self, words: list[str], plain: list[str]) -> None:
        """Words of letters only, with what ``_plain`` makes of them: each is one piece, whose last id ends a word. Checked by
        count; else one by one."""
        starts = range(0, len(words), 512)
        step, cache = self.dtype.itemsize, self.cache
        whole = self.tok if self.plain is None else self.plain
        for i, e in zip(starts, whole.encode_batch_fast([" ".join(plain[i : i + 512]) for i in starts], add_special_tokens=False), strict=True):
            ids, some = np.array(e.ids, self.dtype), words[i : i + 512]
            cuts = np.flatnonzero(self.ends[ids]) + 1
            if len(cuts) == len(some):
                raw = ids.tobytes()
                at = (cuts * step).tolist()
                cache.update(zip(some, [raw[a:b] for a, b in zip([0, *at], at)]))
            else:
                self._single(some)

    def _single(self, chunks: list[str]) -> None:
        for c, e in zip(chunks, self.tok.encode_batch_fast(chunks, add_special_tokens=False), strict=True):
            self.cache[c] = self._raw(e.ids)

    def _plain(self, words: list[str]) -> list[str]:
        """The letters as the byte alphabet has them, so that nothing but the merges is left to do."""
        joined = " ".join(words)
        if self.plain is None or not words:
            return words
        if joined.isascii():
            return joined.lower().split(" ")
        return normalize("NFC", joined).lower().encode().decode("latin-1").translate(BYTES).split(" ")

    def learn(self, chunks: list[str]) -> None:
        """Chunks (each once) of the old generation are taken back; letters, and letters before punctuation, are encoded as
        words."""
        cache, old = self.cache, self.old
        letters, both, single = [], [], []
        for c in chunks:
            if c in old:
                cache[c] = old[c]
            elif c.isalpha():
                (letters if len(c) <= LONG and (c.isascii() or _word(c)) else single).append(c)
            else:
                core = c.rstrip(TAIL) if len(c) <= LONG else ""
                if core.isalpha() and (core.isascii() or _word(core)):
                    both.append((c, core, c[len(core) :]))
                else:
                    single.append(c)
        if both:
            known = {*letters, *single}
            letters += {core for _, core, _ in both if core not in cache} - known
            single += {tail for _, _, tail in both if tail not in cache} - known
        self._letters(letters, self._plain(letters))
        self._single(single)
        for c, core, tail in both:
            cache[c] = cache[core] + cache[tail]

    def _split(self, texts: list[bytes]) -> tuple[pa.DictionaryArray, np.ndarray, np.ndarray]:
        """(parts of chunks, which of them are cores, before their tails; the number of parts up to each text's end). Cores are
        letters, as far as bytes of UTF-8 show: chunks without a core are one part."""
        data = b" ".join([*texts, b""]).translate(SPACES)
        raw = np.frombuffer(data, np.uint8)
        ends = np.flatnonzero(raw == 32)
        last = np.searchsorted(ends, np.cumsum([len(t) + 1 for t in texts])) if texts else np.zeros(0, np.int64)
        some = np.flatnonzero(IS_TAIL[raw[ends - 1]])
        tails = ends[some] - 1
        for _ in range(LONG_TAIL):
            tails -= IS_TAIL[raw[tails - 1]]
        starts = np.where(some > 0, ends[some - 1] + 1, 0)
        other = np.flatnonzero(IS_OTHER[raw])
        cored = (tails > starts) & (np.searchsorted(other, starts) == np.searchsorted(other, tails))
        some, tails = some[cored], tails[cored]
        spaces = np.arange(len(ends))
        at = np.zeros(len(ends) + len(some) + 1, np.int32)
        at[1:] = np.insert(ends - spaces, some, tails - some)  # without the spaces before them
        cores = np.insert(np.zeros(len(ends), bool), some, True)
        parts = pa.StringArray.from_buffers(len(at) - 1, pa.py_buffer(at), pa.py_buffer(data.translate(None, b" ")))
        return parts.dictionary_encode(), cores, last + np.searchsorted(some, last)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.frombuffer(raw, self.dtype) for raw in self.encode_raw(texts)]

    def encode_raw(self, texts: list[str]) -> list[bytes]:
        """The ids as the bytes of ``dtype``."""
        return self.encode_column(texts).to_pylist()

    def encode_column(self, texts: list[str], end: bytes = b"") -> pa.BinaryArray:
        """The ids of each text as the bytes of ``dtype``, followed by ``end``. Arrow numbers the parts of all texts' chunks
        and puts their ids in their places, so that Python works on each different part once."""
        if len(self.cache) > self.limit or self.held > MEAN * self.limit:
            self.old, self.cache, self.held = self.cache, {"": b""}, 0
        # the vocabulary is of lower-cased text; lowering ASCII text beforehand changes nothing but what marks it seems to hold
        lower = [t.lower() if t.isascii() else t for t in texts] if self.lowers else texts
        whole = {i for i, t in enumerate(lower) if not self.parts or any(m in t for m in self.marks)}
        words, cores, last = self._split([b"" if i in whole else t.encode() for i, t in enumerate(lower)])
        names, index = words.dictionary.to_numpy(zero_copy_only=False).tolist(), words.indices.to_numpy()
        is_core = np.zeros(len(names), bool)
        is_core[index[cores]] = True
        odd = [i for i in np.flatnonzero(is_core).tolist() if not names[i].isascii() and not _word(names[i])]
        if odd:  # what looked like a core isn't letters: it is one part with its tail
            is_core[:] = False
            is_core[odd] = True
            at = np.flatnonzero(cores & is_core[index])
            pairs, inverse = np.unique(np.stack([index[at], index[at + 1]]), axis=1, return_inverse=True)
            glued = {names[a] + names[b]: None for a, b in pairs.T.tolist()}
            place = {c: len(names) + 1 + k for k, c in enumerate(glued)}
            index = index.copy()
            index[at + 1] = len(names)
            index[at] = np.array([place[names[a] + names[b]] for a, b in pairs.T.tolist()])[inverse.ravel()]
            names = [*names, "", *glued]
        ids = [*map(self.cache.get, names)]
        missing = [*{c: None for c, x in zip(names, ids) if x is None}]
        if missing:
            self.learn(missing)
            ids = [self.cache[c] if x is None else x for c, x in zip(names, ids)]
            for c in missing:
                if len(c) > LONG:
                    del self.cache[c]
            self.held += sum(len(c) for c in missing if len(c) <= LONG)
        ids.append(end)
        placed = pa.array(ids, pa.binary()).take(pa.array(np.insert(index, last, len(names))))
        at = np.zeros(len(texts) + 1, np.int32)
        at[1:] = np.frombuffer(placed.buffers()[1], np.int32, len(placed) + 1)[last + np.arange(1, len(texts) + 1)]
        out = pa.BinaryArray.from_buffers(pa.binary(), len(texts), [None, pa.py_buffer(at), placed.buffers()[2] or pa.py_buffer(b"")])
        if whole:
            mixed = out.to_pylist()
            for i in whole:
                mixed[i] = self._raw(self.tok.encode(texts[i], add_special_tokens=False).ids) + end
            out = pa.array(mixed, pa.binary())
        return out


_made: dict[str, ChunkTokenizer] = {}
keeps("word tokens", _made.clear)


def chunk_tokenizer(path: str) -> ChunkTokenizer:
    """One tokenizer per worker process, kept for its later tasks."""
    make_room("word tokens")
    if path not in _made:
        _made[path] = ChunkTokenizer(path)
    return _made[path]
