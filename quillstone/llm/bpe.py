"""Byte-pair encoding by a compiled token automaton; decoding by its arc labels.

Gadgets. The token automaton begins as one state with a loop for each byte.
Each merge (u, v) -> w, in order, is one gadget: wherever an arc u leads to a
state with an arc v, an arc w is added to v's target; then u's target is split,
and the copy that u leads to loses its arc v. Where an arc leads depends on its
label alone, so each state is a chain of versions, a parent less one arc; the
chain of token w's state is that of its right part's at w's time. The paths of
the finished automaton are exactly the token sequences that merging yields, and
each string has one such path.

Transitions. Over bytes the automaton isn't deterministic, as a token may still
go on while a shorter one has ended. It is made so by subsets: a state is the
last token of the read prefix's one path and, for each place where a longer
token may have begun, the token before it and the place in the labels' trie.
(state, byte) -> state is a table; an entry is worked out from the gadgets when
a text first needs it, and a full table keeps only what was asked for most often,
so that its size doesn't follow the texts. Words are encoded by stepping through the table,
all words of a block at once; the tokens at the ends of a word's path are then
read back by their lengths. No word is compared with another or kept.
"""

from __future__ import annotations

import base64
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from quillstone.llm.frames import pick
from quillstone.llm.textkit import buffers, expand, slices, tidy

#: Longer words are stepped through one at a time; shorter ones together.
_WIDE = 64
#: Bits of a trie node's number in a state's places.
_NODE = 24
_LOW = (1 << _NODE) - 1
#: Bytes of text that are encoded at a time; what a worker holds grows with it.
BLOCK = 1_500_000


@dataclass
class Automaton:
    """Compiled merges. Tokens are numbered as in the vocabulary.

    left, right, birth: the merge that makes each token; -1 and 0 for bytes, birth -1 for tokens that no text gives.
    state: where a token's arc leads in the end, as a version number.
    trie_keys, trie_next, trie_token: the labels as a byte trie: node * 256 + byte, the node there, and each node's token or -1. Node 0 is the root.
    """

    labels: list[bytes]
    left: np.ndarray
    right: np.ndarray
    birth: np.ndarray
    state: np.ndarray
    sizes: np.ndarray
    trie_keys: np.ndarray
    trie_next: np.ndarray
    trie_token: np.ndarray
    classes: np.ndarray


def compile_merges(labels: list[bytes], merges: list[tuple[int, int, int]]) -> Automaton:
    """The automaton of (u, v, w) merges over tokens; single bytes need none.

    A token that no merge makes and that isn't a byte gets birth -1: no text gives it.
    """
    n = len(labels)
    left, right, birth = np.full(n, -1, np.int64), np.full(n, -1, np.int64), np.full(n, -1, np.int64)
    state, versions = np.zeros(n, np.int64), 1
    for t, label in enumerate(labels):
        if len(label) == 1:
            birth[t] = 0
    for time, (u, v, w) in enumerate(merges, 1):
        left[w], right[w], birth[w] = u, v, time
        state[w] = state[v]  # w leads where v leads
        state[u] = versions  # u now leads to a copy without v
        versions += 1
    step: dict[int, int] = {}
    token = [-1]
    for t, label in enumerate(labels):
        if birth[t] < 0:
            continue
        node = 0
        for b in label:
            key = node << 8 | b
            node = step.get(key)
            if node is None:
                node = step[key] = len(token)
                token.append(-1)
        token[node] = t
    return Automaton(labels, left, right, birth, state, np.array([len(x) for x in labels], np.int64), np.array(list(step), np.int64), np.array(list(step.values()), np.int64), np.array(token, np.int64), _classes())


class Transitions:
    """The table (state, byte) -> state, filled from the gadgets on first need.

    ``most`` bounds the states; beyond it the entries that were asked for most often stay.
    """

    def __init__(self, a: Automaton, most: int = 3 << 16):
        self.a, self.most = a, most
        self.left, self.right, self.birth, self.version = a.left.tolist(), a.right.tolist(), a.birth.tolist(), a.state.tolist()
        self.pairs = {(self.left[t], self.right[t]): k for t, k in enumerate(self.birth) if k > 0}
        self.child = dict(zip(a.trie_keys.tolist(), a.trie_next.tolist(), strict=True))
        self.ends = a.trie_token.tolist()
        inner = np.zeros(len(self.ends), bool)
        inner[a.trie_keys >> 8] = True
        self.inner = inner.tolist()
        self.slots = 1 << max(10, (3 * most).bit_length())
        self.begin()

    def begin(self) -> None:
        """One state: nothing read."""
        self.number: dict[tuple[int, ...], int] = {}
        self.body: list[tuple[int, ...]] = []
        self.last = np.full(1024, -1, np.int32)
        self.has: dict[tuple[int, int], bool] = {}
        self.size = 0
        self.keys = np.full(self.slots, -1, np.int64)
        self.next = np.zeros(self.slots, np.int32)
        self.used = np.zeros(self.slots, np.uint32)  # steps that asked for each entry after the one that made it
        self._state(-1, (0,))

    def _state(self, token: int, open_: tuple[int, ...]) -> int:
        """A state's number. open_: (token before + 1) << _NODE | node, from the longest to the root's; the last has the state's own token."""
        n = self.number.get(open_)
        if n is None:
            n = self.number[open_] = len(self.body)
            self.body.append(open_)
            if n >= len(self.last):
                self.last = np.r_[self.last, np.full(len(self.last), -1, np.int32)]
            self.last[n] = token
        return n

    def arc(self, x: int, y: int) -> bool:
        """Whether the state that token x leads to has an arc y.

        y's gadget added the arc only if y's left part was there at that time;
        x's chain of versions goes on with its right part's at x's time; and a
        gadget of (x, y) cut it. So the question passes to earlier gadgets until
        it is settled.
        """
        key = (self.version[x], y)
        known = self.has.get(key)
        if known is not None:
            return known
        left, right, birth, pairs = self.left, self.right, self.birth, self.pairs
        when, out = 1 << 62, True
        while True:
            if pairs.get((x, y), when) < when:
                out = False
                break
            bx, by = birth[x], birth[y]
            if by > bx:
                if left[y] == x == right[y]:  # u, uu: merging takes the left pair first
                    out = False
                    break
                when, y = by, left[y]
            elif bx:
                when = bx
                if x == y:  # a token after itself: its own gadget made the state and the arc
                    y = left[y]
                x = right[x]
            else:
                break
        if len(self.has) < 4 * self.most:
            self.has[key] = out
        return out

    def compile(self, state: int, byte: int) -> int:
        """The state after one more byte: the places in the trie move on; of the
        tokens that end here the one whose arc is there is the path's, the
        longest that is being the only one."""
        get, ends, inner = self.child.get, self.ends, self.inner
        out, token = [], -1
        for place in self.body[state]:
            node = get((place & _LOW) << 8 | byte)
            if node is None:
                continue
            if token < 0:
                t, before = ends[node], place >> _NODE
                if t >= 0 and (not before or self.arc(before - 1, t)):
                    token = t
            if inner[node]:
                out.append(place & ~_LOW | node)
        if token < 0:
            raise ValueError(f"the vocabulary has no token for the byte {byte}")
        out.append(token + 1 << _NODE)
        return self._state(token, tuple(out))

    def room(self) -> None:
        """Makes room where a block may not fit any more; called between blocks of words."""
        if len(self.body) > self.most or 2 * self.size > self.slots:
            self.keep()

    def keep(self) -> None:
        """Drops all but the entries that were asked for most often, half as many as states are allowed, and numbers their states anew."""
        kept = np.flatnonzero(self.used)
        kept = kept[np.argsort(-self.used[kept].astype(np.int64), kind="stable")[: self.most // 2]]
        keys, after = self.keys[kept], self.next[kept]
        states = np.unique(np.r_[0, keys >> 8, after])
        if 4 * len(states) > 3 * self.most:
            self.begin()
            return
        body, last, has = [self.body[i] for i in states.tolist()], self.last[states], self.has
        self.begin()
        self.body, self.last = body, last
        self.number = {b: i for i, b in enumerate(body)}
        self.has = has if len(has) <= self.most else {}
        self._fill(np.searchsorted(states, keys >> 8) << 8 | keys & 255, np.searchsorted(states, after))
        self.size = len(keys)

    def _fill(self, keys: np.ndarray, after: np.ndarray) -> None:
        """Puts entries into the empty table."""
        for key, made in zip(keys.tolist(), after.tolist(), strict=True):
            slot = (key * 0x9E3779B1 >> 7) & (self.slots - 1)
            while self.keys[slot] >= 0:
                slot = (slot + 1) & (self.slots - 1)
            self.keys[slot], self.next[slot] = key, made

    def step(self, state: np.ndarray, byte: np.ndarray) -> np.ndarray:
        """The next states, by the table."""
        key = state.astype(np.int64) << 8 | byte
        mask = self.slots - 1
        slot = (key * 0x9E3779B1 >> 7) & mask
        out = self.next[slot]
        hit = self.keys[slot] == key
        self.used[slot[hit]] += 1
        miss = np.flatnonzero(~hit)
        while len(miss):
            at = slot[miss]
            free = self.keys[at] < 0
            if free.any():
                fresh, back = np.unique(key[miss[free]], return_inverse=True)
                made = np.fromiter((self._put(k) for k in fresh.tolist()), np.int32, len(fresh))
                out[miss[free]] = made[back]
                miss = miss[~free]
                if not len(miss):
                    break
                at = slot[miss]
            out[miss] = self.next[at]
            hit = self.keys[at] == key[miss]
            self.used[at[hit]] += 1
            miss = miss[~hit]
            slot[miss] = (slot[miss] + 1) & mask
        return out

    def _put(self, key: int) -> int:
        """The next state of one key, from the table or compiled into it."""
        slot, keys = (key * 0x9E3779B1 >> 7) & (self.slots - 1), self.keys
        while keys[slot] >= 0:
            if keys[slot] == key:
                return int(self.next[slot])
            slot = (slot + 1) & (self.slots - 1)
        if 4 * self.size > 3 * self.slots:  # one block with more transitions than the table is meant for
            self._wider()
            return self._put(key)
        made = self.compile(key >> 8, key & 255)
        keys[slot], self.next[slot] = key, made
        self.size += 1
        return made

    def _wider(self) -> None:
        kept = np.flatnonzero(self.keys >= 0)
        keys, after = self.keys[kept], self.next[kept]
        self.slots *= 2
        self.keys, self.next, self.used = np.full(self.slots, -1, np.int64), np.zeros(self.slots, np.int32), np.zeros(self.slots, np.uint32)
        self._fill(keys, after)

    def tokens(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """For each byte of the words, the last token of the path up to it."""
        self.room()
        token = np.full(len(data), -1, np.int32)
        size = ends - starts
        order = np.argsort(-np.minimum(size, _WIDE + 1).astype(np.int16), kind="stable")
        wide = int((size > _WIDE).sum())
        for w in order[:wide].tolist():
            state = 0
            for at in range(int(starts[w]), int(ends[w])):
                state = self._put(state << 8 | int(data[at]))
                token[at] = self.last[state]
                if len(self.body) > 4 * self.most:  # one very long word: its state is carried over
                    body = self.body[state]
                    self.begin()
                    state = self._state(int(token[at]), body)
        order = order[wide:]
        at, size = starts[order], size[order]
        alive = np.searchsorted(-size, -np.arange(int(size.max(initial=0))), "left")
        state = np.zeros(len(order), np.int32)
        for i, n in enumerate(alive.tolist()):
            here = at[:n] + i
            state = self.step(state[:n], data[here])
            token[here] = self.last[state]
        return token


def encode_words(table: Transitions, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Token ids of the words, which cover ``data`` in their order, and the byte where each token ends."""
    token = table.tokens(data, starts, ends)
    final = np.zeros(len(data), bool)
    at, low = ends - 1, starts
    while len(at):
        final[at] = True
        at = at - table.a.sizes[token[at]]
        go = at >= low
        at, low = at[go], low[go]
    where = np.flatnonzero(final)
    return token[where], where


# Pre-splitting. Classes: 0 other, 1 letter, 2 number, 3 white space.
@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """Of each code point; made on the driver and sent with the automaton."""
    out = np.zeros(0x110000, np.uint8)
    for c in range(0x110000):
        k = unicodedata.category(chr(c))[0]
        out[c] = 1 if k == "L" else 2 if k == "N" else 0
    for c in [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]:
        out[c] = 3
    return out


def presplit(data: np.ndarray, off: np.ndarray, classes: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the pre-split words in UTF-8 texts (a word ends where the next
    begins), by the usual pattern
    's|'t|'re|'ve|'m|'ll|'d| ?L+| ?N+| ?[^\\sLN]+|\\s+(?!\\S)|\\s+ ; and their texts."""
    if not len(data):
        e = np.zeros(0, np.int64)
        return e, e
    at = np.flatnonzero((data & 0xC0) != 0x80)  # characters
    lead = data[at].astype(np.int64)
    code = lead.copy()
    wide = np.flatnonzero(lead >= 0x80)
    if len(wide):
        b = np.r_[data, np.zeros(4, np.uint8)].astype(np.int64)
        p, c = at[wide], lead[wide]
        two = ((c & 0x1F) << 6) | (b[p + 1] & 0x3F)
        three = ((c & 0x0F) << 12) | ((b[p + 1] & 0x3F) << 6) | (b[p + 2] & 0x3F)
        four = ((c & 0x07) << 18) | ((b[p + 1] & 0x3F) << 12) | ((b[p + 2] & 0x3F) << 6) | (b[p + 3] & 0x3F)
        code[wide] = np.where(c < 0xE0, two, np.where(c < 0xF0, three, np.minimum(four, 0x10FFFF)))
    kind = (_classes() if classes is None else classes)[code]
    n = len(at)
    begins = np.zeros(n + 1, bool)  # text limits, by character
    begins[np.searchsorted(at, off)] = True
    change = np.ones(n + 1, bool)
    change[1:n] = (kind[1:] != kind[:-1]) | begins[1:n]
    word = change.copy()
    # the last blank of a run goes to what follows it, or stands alone
    tail = np.flatnonzero(change[1:n] & (kind[: n - 1] == 3) & ~begins[1:n])
    word[tail] = True
    word[tail[code[tail] == 32] + 1] = False
    # contractions: an apostrophe that begins a word, alone, before letters
    for q in np.flatnonzero((code == 39) & word[:n] & change[1:] & np.r_[kind[1:] == 1, False] & ~begins[1:]):
        one = code[q + 1]
        if one in (115, 116, 109, 100):
            k = 1
        elif q + 2 < n and not begins[q + 2] and (one, code[q + 2]) in ((114, 101), (118, 101), (108, 108)):
            k = 2
        else:
            continue
        word[q + 1] = False
        if q + 1 + k < n:
            word[q + 1 + k] = True
    starts = at[np.flatnonzero(word[:n])]
    return starts, np.searchsorted(off, starts, "right") - 1


class Encoder:
    """Encodes texts by words, through one table of transitions."""

    def __init__(self, automaton: Automaton, most: int = 3 << 16):
        self.a, self.table = automaton, Transitions(automaton, most)
        self.label_data = np.frombuffer(b"".join(automaton.labels), np.uint8)
        self.label_off = np.r_[0, np.cumsum(automaton.sizes)]

    def encode(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts of a block, flattened, and offsets by text."""
        if not len(data):
            return np.zeros(0, np.int32), np.zeros(len(off), np.int64)
        starts, _ = presplit(data, off, self.a.classes)
        ids, where = encode_words(self.table, data, starts, np.r_[starts[1:], len(data)])
        return ids, np.searchsorted(where, off, "left")

    def decode(self, ids: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The labels of the ids: bytes of all texts, and offsets by text."""
        size = self.a.sizes[ids]
        ends = np.r_[0, np.cumsum(size)]
        return self.label_data[expand(self.label_off[ids], size)], ends[off]


def load_tiktoken(path: str) -> Automaton:
    """A vocabulary of base64 tokens and ranks; ranks are the ids and the merge order."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    labels = [b""] * (max(ranks.values()) + 1)
    for t, r in ranks.items():
        labels[r] = t
    merges = []
    for t, r in sorted(ranks.items(), key=lambda x: x[1]):
        if len(t) < 2:
            continue
        parts = [t[i : i + 1] for i in range(len(t))]
        while len(parts) > 2:
            best, where = r, -1
            for i in range(len(parts) - 1):
                k = ranks.get(parts[i] + parts[i + 1], r)
                if k < best:
                    best, where = k, i
            if where < 0:
                break
            parts[where : where + 2] = [parts[where] + parts[where + 1]]
        if len(parts) == 2:
            merges.append((ranks[parts[0]], ranks[parts[1]], r))
    return compile_merges(labels, merges)


@lru_cache(maxsize=2)
def tokenizer(path: str) -> Automaton:
    return load_tiktoken(path)


_encoders: dict[int, Encoder] = {}


def encoder(shared) -> Encoder:
    """This worker's encoder for a broadcast automaton."""
    if id(shared.value) not in _encoders:
        _encoders.clear()
        _encoders[id(shared.value)] = Encoder(shared.value)
    return _encoders[id(shared.value)]


def release_encoders() -> None:
    """Gives this worker's encoder and its table back; what needs one makes it anew."""
    _encoders.clear()


def bpe_encode(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids ARRAY<INT>, n_tokens, round_trip) of whole texts; map only.

    The vocabulary file is read on the driver and its automaton broadcast (a
    size that doesn't grow with the data). round_trip: the labels of the ids,
    put together, are the text's bytes.

    Null text: null ids. Empty text: no ids. Very long texts are encoded in
    whole, and so are very long words. Strings that look like special tokens are
    ordinary text. A text has one encoding, so there are no ties. Repeated rows:
    a row each. Null ids stay null. An empty table gives no rows. Other columns
    are ignored, whatever their names.
    """
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("n_tokens", T.IntegerType()), T.StructField("round_trip", T.BooleanType())])
    shared = docs.sparkSession.sparkContext.broadcast(tokenizer(tokenizer_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(shared)
        for batch in batches:
            for a, texts in slices(batch.column(1), BLOCK):
                part, at = buffers(texts)
                b = a + len(texts)
                ids, ends = e.encode(part, at)
                plain, back = e.decode(ids, ends)
                whole = np.array_equal(back, at) and np.array_equal(plain, part)
                same = np.array([whole or plain[back[i] : back[i + 1]].tobytes() == part[at[i] : at[i + 1]].tobytes() for i in range(b - a)], bool)
                null = np.asarray(batch.column(1).slice(a, b - a).is_null())
                mask = pa.array(null)
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids, pa.int32()), mask=mask)
                yield pa.record_batch([batch.column(0).slice(a, b - a), lists, pa.array(np.diff(ends), pa.int32(), mask=null), pa.array(same, mask=null)], schema.names)

    return pick(docs, id_col, text_col).mapInArrow(tidy(run), schema)


def bpe_decode(tokens: DataFrame, tokenizer_path: str, id_col: str = "doc_id", ids_col: str = "ids", text_col: str = "text") -> DataFrame:
    """(id, text) from token ids, by their labels; map only.

    Null ids: null text. No ids: an empty text. Ids out of the vocabulary are an
    error. Bytes that aren't UTF-8 become U+FFFD. Long lists are decoded in
    whole. Repeated rows: a row each; the rows' own ids may be null. An empty
    table gives no rows. Other columns are ignored, whatever their names.
    """
    schema = T.StructType([T.StructField(id_col, tokens.schema[id_col].dataType), T.StructField(text_col, T.StringType())])
    shared = tokens.sparkSession.sparkContext.broadcast(tokenizer(tokenizer_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(shared)
        for batch in batches:
            texts = []
            for x in batch.column(1):
                if not x.is_valid:
                    texts.append(None)
                    continue
                ids = np.asarray(x.values).astype(np.int64)
                if len(ids) and (ids.min() < 0 or ids.max() >= len(e.a.labels)):
                    raise ValueError("a token id lies outside the vocabulary")
                texts.append(e.decode(ids, np.array([0, len(ids)]))[0].tobytes().decode(errors="replace"))
            yield pa.record_batch([batch.column(0), pa.array(texts, pa.string())], schema.names)

    return pick(tokens, id_col, ids_col).mapInArrow(tidy(run), schema)
