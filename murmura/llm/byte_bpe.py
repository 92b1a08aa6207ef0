"""Byte-level BPE as a lazily determinised finite-state transducer, and streaming decode by a UTF-8 state machine.

The merges of a byte string are fixed by its neighbouring tokens: a token sequence is what the merges give exactly if
each adjacent pair is what the merges give for that pair's bytes. So one nondeterministic machine reads bytes, guesses
tokens along a trie and lets a token follow only where the pair agrees; each prefix of the input has one surviving
sequence, and so one last token. The machine's subsets (the trie nodes of the tokens that may be under way, each with the
token before it) are made as they are met. A move's output is the last token of the prefix read so far; tokens are settled,
and emitted, up to the place where the ways to all tokens under way part, which the longest token's length bounds.
"""

from __future__ import annotations

import base64
from struct import pack

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keeps, make_room, slices, small_batches, texts_of


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def merge(ranks: dict[bytes, int], piece: bytes) -> list[int]:
    """Plain merging, lowest rank first: the definition, used to judge single tokens and pairs of them."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while len(parts) > 1:
        best = min(((ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1)))
        if best[0] == 1 << 60:
            break
        i = best[1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return [ranks[p] for p in parts]


class Transducer:
    """Encodes single pieces. ``states`` bounds the determinised machine, which starts anew beyond it."""

    ROOT = 0

    def __init__(self, ranks: dict[bytes, int], states: int = 400_000):
        self.ranks, self.limit = ranks, states
        self.vocab = {i: b for b, i in ranks.items()}
        #: by trie node: the child by the next byte, and the token that ends there (-1: none)
        self.kids: list[dict[int, int]] = [{}]
        self.token, self.depth = [-1], [0]
        for piece, rank in ranks.items():
            node = 0
            for b in piece:
                nxt = self.kids[node].get(b)
                if nxt is None:
                    nxt = self.kids[node][b] = len(self.token)
                    self.kids.append({})
                    self.token.append(-1)
                    self.depth.append(self.depth[node] + 1)
                node = nxt
            self.token[node] = rank
        self.halves: dict[int, tuple[int, int]] = {}
        #: by last << 20 | token
        self.agree: dict[int, bool] = {}
        self.whole: dict[int, bool] = {}
        self._reset()

    def _reset(self) -> None:
        start = ((self.ROOT, -1),)
        self.number, self.content = {start: 0}, [start]
        #: by state: next state and last token, by the next byte
        self.moves: list[dict[int, tuple[int, int]]] = [{}]

    def _parts(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge ends the making of ``token``; None for a single byte."""
        data = self.vocab[token]
        if len(data) == 1:
            return None
        got = self.halves.get(token)
        if got is None:
            less = {b: r for i in range(len(data)) for j in range(i + 1, len(data) + 1) if (r := self.ranks.get(b := data[i:j], token)) != token}
            got = self.halves[token] = tuple(merge(less, data))
        return got

    def _follows(self, last: int, token: int) -> bool:
        """Whether ``token`` may follow ``last`` (-1: the piece's start).

        Both tokens are unmade from their last merges on, newest first, on the sides that meet; they may not follow if
        the parts that meet at some time would have merged with each other before the merge that is unmade there.
        """
        if last < 0:
            known = self.whole.get(token)
            if known is None:
                known = self.whole[token] = merge(self.ranks, self.vocab[token]) == [token]
            self.agree[last << 20 | token] = known
            return known
        known = self.agree.get(last << 20 | token)
        if known is None:
            if len(self.agree) > 2 * self.limit:
                self.agree.clear()
            if not (self._follows(-1, last) and self._follows(-1, token)):
                known = False
            else:
                known, left, right, before = True, last, token, 1 << 60
                while True:
                    if self.ranks.get(self.vocab[left] + self.vocab[right], 1 << 60) < before:
                        known = False
                        break
                    a, b = self._parts(left), self._parts(right)
                    if a is None and b is None:
                        break
                    # of equal merges the left one comes first, so that on the right is unmade first and loses to a tie
                    if b is None or a is not None and left > right:
                        before, left = left, a[1]
                    else:
                        before, right = right + 1, b[0]
            self.agree[last << 20 | token] = known
        return known

    def _step(self, state: int, byte: int) -> tuple[int, int]:
        live, done, kids, tokens, agree = [], -1, self.kids, self.token, self.agree
        for node, last in self.content[state]:
            child = kids[node].get(byte)
            if child is not None:
                token = tokens[child]
                if done < 0 <= token:
                    known = agree.get(last << 20 | token)
                    if self._follows(last, token) if known is None else known:
                        done = token
                if kids[child]:
                    live.append((child, last))
        live.append((self.ROOT, done))
        self.moves[state][byte] = move = (self._number(tuple(live)), done)
        return move

    def _number(self, content: tuple) -> int:
        """The state of these nodes, made if it isn't there."""
        state = self.number.get(content)
        if state is None:
            state = self.number[content] = len(self.content)
            self.content.append(content)
            self.moves.append({})
        return state

    def _settled(self, state: int, lasts: list[int], read: int) -> int:
        """Up to where the ways to all tokens under way are one: a place among the ``read`` bytes held."""
        ends = {read - self.depth[node] for node, _ in self.content[state]}
        while len(ends) > 1:
            far = max(ends)
            ends.remove(far)
            ends.add(far - len(self.vocab[lasts[far - 1]]))
        return ends.pop()

    def _back(self, lasts: list[int], end: int) -> list[int]:
        out = []
        while end:
            token = lasts[end - 1]
            out.append(token)
            end -= len(self.vocab[token])
        out.reverse()
        return out

    def stream(self, piece: bytes, hold: int = 4096):
        """The piece's tokens in lists, as they are settled; about ``hold`` bytes are held back at most."""
        if len(self.content) > self.limit:
            self._reset()
        state, lasts, moves = 0, [], self.moves
        for byte in piece:
            state, last = moves[state].get(byte) or self._step(state, byte)
            lasts.append(last)
            if len(lasts) >= hold:
                end = self._settled(state, lasts, len(lasts))
                yield self._back(lasts, end)
                del lasts[:end]
                if len(self.content) > self.limit:  # also within a piece: only the state that it is in is kept
                    now = self.content[state]
                    self._reset()
                    state, moves = self._number(now), self.moves
        yield self._back(lasts, len(lasts))

    def encode(self, piece: bytes) -> list[int]:
        """As the tiktoken library: a piece that is itself in the vocabulary is that token."""
        if (known := self.ranks.get(piece)) is not None:
            return [known]
        if len(piece) > 4096:
            return [t for part in self.stream(piece) for t in part]
        if len(self.content) > self.limit:
            self._reset()
        state, lasts, moves, step = 0, [], self.moves, self._step
        for byte in piece:
            state, last = moves[state].get(byte) or step(state, byte)
            lasts.append(last)
        return self._back(lasts, len(lasts))


#: Matches of more characters aren't kept; so many characters a generation may hold for each match of its limit.
LONG, MEAN = 64, 16


class Encoder:
    """Whole texts: the pattern's matches one by one, with a cache of matches of at most ``LONG`` characters in two generations
    of at most ``cache`` matches and ``MEAN`` times ``cache`` characters."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, cache: int = 350_000):
        import regex

        self.find = regex.compile(pattern).findall
        self.machine, self.limit = Transducer(ranks), cache
        self.cache: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.held = 0

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit."""
        pieces, cache = self.find(text), self.cache
        if len(cache) > self.limit or self.held > MEAN * self.limit:
            self.old, self.cache, self.held = cache, (cache := {}), 0
        missing, far = set(pieces).difference(cache), []
        if missing:
            old, run = self.old, self.machine.encode
            for p in missing:
                ids = old.get(p)
                if ids is None:
                    tokens = run(p.encode())
                    ids = pack(f"<{len(tokens)}I", *tokens)
                cache[p] = ids
                if len(p) > LONG:
                    far.append(p)
                else:
                    self.held += len(p)
        out = b"".join(map(cache.__getitem__, pieces))
        for p in far:
            del cache[p]
        return out


def utf8_table() -> list[list[int]]:
    """Next state by state and byte. 0: at a character's end; 1-3: so many bytes to come; 4-7: the second byte after
    E0, ED, F0 or F4, whose range is narrower; 8: not UTF-8."""
    table = [[8] * 256 for _ in range(9)]
    for b in range(0x80):
        table[0][b] = 0
    for b in range(0xC2, 0xE0):
        table[0][b] = 1
    for b in range(0xE0, 0xF0):
        table[0][b] = {0xE0: 4, 0xED: 5}.get(b, 2)
    for b in range(0xF0, 0xF5):
        table[0][b] = {0xF0: 6, 0xF4: 7}.get(b, 3)
    for state, low, high, to in ((1, 0x80, 0xBF, 0), (2, 0x80, 0xBF, 1), (3, 0x80, 0xBF, 2), (4, 0xA0, 0xBF, 1), (5, 0x80, 0x9F, 1), (6, 0x90, 0xBF, 2), (7, 0x80, 0x8F, 2)):
        for b in range(low, high + 1):
            table[state][b] = to
    return table


class Utf8Stream:
    """Streaming decode: ``feed`` takes some ids and returns the bytes of all characters that are complete by then;
    ``close`` returns what is left (bytes of an unfinished or invalid character pass through unchanged).

    The machine's move over a whole token is remembered by (state, token)."""

    TABLE = utf8_table()
    #: by vocabulary: moves by (state, token), and whether a token is whole characters from state 0 on
    known: dict[int, tuple[dict, bytearray, dict]] = {}

    def __init__(self, vocab: dict[int, bytes]):
        self.vocab, self.state, self.held = vocab, 0, b""
        if id(vocab) not in self.known:
            whole = bytearray(max(vocab) + 1)
            for t in vocab:
                whole[t] = self._over(0, t) == (0, 0)
            self.known[id(vocab)] = {}, whole, vocab  # held, so that the id stays its own
        self.memo, self.whole, _ = self.known[id(vocab)]

    def _over(self, state: int, token: int) -> tuple[int, int]:
        """(state after the token, how many of its last bytes belong to an unfinished character; -1: all and more).

        A byte that can't go on with a character ends that one and is looked at anew; one that can't begin one is alone."""
        data = self.vocab[token]
        begin = -1 if state else 0
        for i, b in enumerate(data):
            to = self.TABLE[state][b]
            if to == 8:
                to, state = self.TABLE[0][b], 0
            if to == 8:
                to = 0
            if to == 0:
                begin = i + 1
            elif state == 0:
                begin = i
            state = to
        return state, -1 if begin < 0 else len(data) - begin if state else 0

    def feed(self, ids: list[int]) -> bytes:
        state, memo, whole, size = self.state, self.memo, self.whole, len(self.whole)
        data = b"".join(map(self.vocab.__getitem__, ids))
        open_bytes = len(self.held)
        for t in ids:
            if not state and whole[t]:
                continue
            got = memo.get(state * size + t)
            if got is None:
                got = memo[state * size + t] = self._over(state, t)
            state, unfinished = got
            open_bytes = unfinished if unfinished >= 0 else open_bytes + len(self.vocab[t])
        self.state = state
        data = self.held + data
        cut = len(data) - open_bytes
        self.held = data[cut:]
        return data[:cut]

    def close(self) -> bytes:
        out, self.held, self.state = self.held, b"", 0
        return out


_made: dict[tuple[str, str], tuple[Encoder, dict[int, bytes]]] = {}


def _clear() -> None:
    _made.clear()
    Utf8Stream.known.clear()


keeps("byte tokens", _clear)


def coder(path: str, pattern: str) -> tuple[Encoder, dict[int, bytes]]:
    """One encoder per worker process, kept for its later tasks."""
    make_room("byte tokens")
    if (path, pattern) not in _made:
        ranks = read_ranks(path)
        _made[path, pattern] = Encoder(ranks, pattern), {i: b for b, i in ranks.items()}
    return _made[path, pattern]


def encode(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """(doc_id, ids binary): the ids of each whole text (null: empty) as little-endian unsigned 32-bit.

    One row out for each row in, also where doc_ids repeat or are null; other columns are ignored; no shuffle.
    """

    small_batches(docs.sparkSession)

    def run(batches):
        encoder, _ = coder(ranks_path, pattern)
        for batch in batches:
            for part in slices(batch, "text"):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([encoder.encode(t) for t in texts_of(part)], pa.binary())], ["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text")).mapInArrow(run, "doc_id long, ids binary")


def _text_bytes(vocab: dict[int, bytes], raw: bytes, step: int) -> bytes:
    ids, stream = np.frombuffer(raw, "<u4").tolist(), Utf8Stream(vocab)
    return b"".join([*(stream.feed(ids[i : i + step]) for i in range(0, len(ids), step)), stream.close()])


def decode(tokens: DataFrame, ranks_path: str, pattern: str, step: int = 4096) -> DataFrame:
    """``tokens`` with ``data`` binary: the bytes of its ``ids``, decoded ``step`` ids at a time."""

    def run(batches):
        _, vocab = coder(ranks_path, pattern)
        for batch in batches:
            for part in slices(batch, "ids"):
                out = [_text_bytes(vocab, raw, step) for raw in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(out, pa.binary())], ["doc_id", "ids", "data"])

    return tokens.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids binary, data binary")


def recode(docs: DataFrame, ranks_path: str, pattern: str, step: int = 4096) -> DataFrame:
    """``encode`` and ``decode`` in one pass of one worker: (doc_id, ids, data)."""

    small_batches(docs.sparkSession)

    def run(batches):
        encoder, vocab = coder(ranks_path, pattern)
        for batch in batches:
            for part in slices(batch, "text"):
                coded = [encoder.encode(t) for t in texts_of(part)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(coded, pa.binary()), pa.array([_text_bytes(vocab, c, step) for c in coded], pa.binary())], ["doc_id", "ids", "data"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text")).mapInArrow(run, "doc_id long, ids binary, data binary")
