"""Byte-pair encoding by dynamic programming over prefixes, and decoding.

For each prefix of a piece there is exactly one token that its encoding ends in. It is found among the vocabulary
tokens that end there (matched by walking an automaton of all token suffixes backwards) as the one that is compatible
with the last token of the prefix before it: two neighbours are compatible if no merge across their border would ever
have come first. Back-pointers from the end give the ids. Pieces are encoded together, as arrays, and kept per task,
since words repeat.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed by the vocabulary's format: how a text is split before any merge.
SPLIT = regex.compile(r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""")
#: From here on there are characters that younger Unicode versions assign; none of them is below.
YOUNG = re.compile("[\u0558-\U0010ffff]")
#: Pieces kept in one task before the store is emptied.
KEPT = 400_000
NEVER = 1 << 30


@lru_cache(1)
def byte_of_char() -> dict[str, int]:
    """The format writes each byte as a printable character: itself where it is one, else the next from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Vocabulary:
    """Tables of a byte-level BPE file of the tokenizers library."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, to_byte = spec["model"], byte_of_char()
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        ids = {k: v for k, v in model["vocab"].items() if k not in self.special}
        size = max([*ids.values(), *self.special.values()]) + 1
        self.tokens = [b""] * size
        for k, v in ids.items():
            self.tokens[v] = bytes(to_byte[c] for c in k)
        for k, v in self.special.items():
            self.tokens[v] = k.encode()
        self.decimal = [str(i) for i in range(size)]
        self.length = np.array([len(t) for t in self.tokens], np.int64)
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        left = np.array([ids[a] for a, _ in pairs], np.int64)
        right = np.array([ids[b] for _, b in pairs], np.int64)
        made = np.array([ids[a + b] for a, b in pairs], np.int64)
        self._size = size
        keys = left * size + right
        order = np.argsort(keys)
        self.pair_keys, self.pair_rank = keys[order], order.astype(np.int64)
        # how each token is made; a token that merges do not make of its own bytes can never come out
        halves = {int(m): (int(a), int(b), r) for r, (m, a, b) in reversed(list(enumerate(zip(made, left, right, strict=True))))}
        self._spines(halves, size)
        self._automaton([v for v in ids.values() if len(self.tokens[v]) == 1 or v in halves])

    def _spines(self, halves: dict[int, tuple[int, int, int]], size: int) -> None:
        """Per token, what stands at its right (left) edge while it is made, and the rank of the merge that swallows it."""
        def spine(t: int, side: int) -> list[tuple[int, int]]:
            out, up = [(t, NEVER)], NEVER
            while t in halves:
                up = halves[t][2]
                t = halves[t][side]
                out.append((t, up))
            return out

        for name, side in (("right", 1), ("left", 0)):
            rows = [spine(t, side) for t in range(size)]
            deep = max(map(len, rows))
            token, up = np.full((size, deep), -1, np.int32), np.zeros((size, deep), np.int32)
            for i, row in enumerate(rows):
                token[i, : len(row)], up[i, : len(row)] = zip(*row, strict=True)
            setattr(self, f"{name}_edge", token)
            setattr(self, f"{name}_up", up)

    def _automaton(self, usable: list[int]) -> None:
        """Walked from a place backwards, it passes every token that ends there."""
        step: list[dict[int, int]] = [{}]
        token = [-1]
        for t in usable:
            node = 0
            for c in reversed(self.tokens[t]):
                to = step[node].get(c)
                if to is None:
                    to = step[node][c] = len(step)
                    step.append({})
                    token.append(-1)
                node = to
            token[node] = t
        inner = [i for i, x in enumerate(step) if x]
        place = np.full(len(step), -1, np.int32)
        place[inner] = np.arange(len(inner))
        table = np.full((len(inner), 256), -1, np.int32)
        for row, i in enumerate(inner):
            for c, to in step[i].items():
                table[row, c] = to
        self.node_row, self.node_step, self.node_token = place, table, np.array(token, np.int32)

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether tokens a and b stay apart side by side: no pair at their border would merge before both are whole."""
        ok = np.ones(len(a), bool)
        for i in range(self.right_edge.shape[1]):
            x = self.right_edge[a, i]
            live = np.flatnonzero(ok & (x >= 0))
            if not len(live):
                break
            for j in range(self.left_edge.shape[1]):
                y = self.left_edge[b[live], j]
                there = y >= 0
                live, y = live[there], y[there]
                if not len(live):
                    break
                key = x[live].astype(np.int64) * self._size + y
                at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
                hit = self.pair_keys[at] == key
                rank = np.where(hit, self.pair_rank[at], NEVER)
                # of equal merges the one further left comes first: x goes into its own, or takes y before y's own
                ok[live[(rank < self.right_up[a[live], i]) & (rank <= self.left_up[b[live], j]) & hit]] = False
        return ok


class Encoder:
    """Encodes pieces with a vocabulary and keeps what it has encoded."""

    def __init__(self, vocabulary: Vocabulary, path: str):
        self.v = vocabulary
        self._path = path
        self._library = None
        self.kept: dict[str, bytes] = {}
        self._pair_key = np.full(1 << 20, -1, np.int64)
        self._pair_ok = np.zeros(1 << 20, bool)

    def _fits(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a.astype(np.int64) * self.v._size + b
        slot = ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44)).astype(np.int64)
        new = self._pair_key[slot] != key
        out = self._pair_ok[slot]
        if new.any():
            k, back = np.unique(key[new], return_inverse=True)
            ok = self.v.compatible(k // self.v._size, k % self.v._size)
            out[new] = ok[back]
            self._pair_key[slot[new]], self._pair_ok[slot[new]] = key[new], out[new]
            wrong = self._pair_key[slot[new]] != key[new]  # two keys of one slot: the last one stays, with its own answer
            if wrong.any():
                s = slot[new][wrong]
                self._pair_key[s] = -1
        return out

    def encode_pieces(self, pieces: list[bytes]) -> list[np.ndarray]:
        """The ids of each piece."""
        out: list[np.ndarray] = [np.empty(0, np.int32)] * len(pieces)
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        order = np.argsort(sizes, kind="stable")
        order = order[sizes[order] > 0]
        start = 0
        while start < len(order):  # pieces of like length together, at most 4 MB at once
            longest, end = sizes[order[start]], start + 1
            while end < len(order) and sizes[order[end]] <= max(16, 2 * longest) and (end - start) * sizes[order[end]] < 4 << 20:
                end += 1
            part = order[start:end]
            for i, ids in zip(part.tolist(), self._encode([pieces[i] for i in part.tolist()]), strict=True):
                out[i] = ids
            start = end
        return out

    def _encode(self, pieces: list[bytes]) -> list[np.ndarray]:
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        ends = np.cumsum(sizes)
        starts = ends - sizes
        data = np.frombuffer(b"".join(pieces), np.uint8)
        begin = np.repeat(starts, sizes)
        # every token that ends at each place
        at, node, back = np.arange(len(data)), np.zeros(len(data), np.int32), 0
        found_end, found_token = [], []
        while len(at):
            row = self.v.node_row[node]
            go = (row >= 0) & (at - back >= begin[at])
            at, row = at[go], row[go]
            node = self.v.node_step[row, data[at - back]]
            go = node >= 0
            at, node = at[go], node[go]
            back += 1
            t = self.v.node_token[node]
            hit = t >= 0
            found_end.append(at[hit])
            found_token.append(t[hit])
        end, token = np.concatenate(found_end), np.concatenate(found_token)
        # prefixes of one length together, since they need only shorter ones
        length = end - begin[end] + 1
        order = np.argsort(length, kind="stable")
        end, token, length = end[order], token[order], length[order]
        cuts = np.searchsorted(length, np.arange(1, int(sizes.max()) + 2))
        last = np.full(len(data), -1, np.int32)
        for n in range(int(sizes.max())):
            e, t = end[cuts[n] : cuts[n + 1]], token[cuts[n] : cuts[n + 1]]
            if not len(e):
                continue
            before = e - self.v.length[t]
            whole = before < begin[e]
            good = whole.copy()
            rest = np.flatnonzero(~whole)
            p = last[before[rest]]
            rest, p = rest[p >= 0], p[p >= 0]
            good[rest] = self._fits(p, t[rest])
            last[e[good]] = t[good]
        at, which, ids, owner = ends - 1, np.arange(len(pieces)), [], []
        while len(at):
            t = last[at]
            ids.append(t)
            owner.append(which)
            at = at - self.v.length[t]
            go = at >= starts[which]
            at, which = at[go], which[go]
        ids, owner = np.concatenate(ids[::-1]), np.concatenate(owner[::-1])
        order = np.argsort(owner, kind="stable")
        return np.split(ids[order], np.cumsum(np.bincount(owner, minlength=len(pieces)))[:-1])

    def _split(self, text: str) -> list[str]:
        """Pieces. Characters that Python's Unicode tables do not know are classed by the library's splitter."""
        if not YOUNG.search(text) or not any(unicodedata.category(c) == "Cn" for c in set(text)):
            return SPLIT.findall(text)
        if self._library is None:
            from tokenizers import Tokenizer

            self._library = Tokenizer.from_file(self._path).pre_tokenizer
        return [text[a:b] for _, (a, b) in self._library.pre_tokenize_str(text)]

    def _pieces(self, text: str) -> list[str | int]:
        """Pieces of the text, and the ids of special tokens in it."""
        if not any(s in text for s in self.v.special):
            return self._split(text)
        out: list[str | int] = []
        for part in regex.split("(" + "|".join(map(regex.escape, sorted(self.v.special, key=len, reverse=True))) + ")", text):
            out += [self.v.special[part]] if part in self.v.special else self._split(part)
        return out

    def encode_batch(self, texts: list[str]) -> Iterator[np.ndarray]:
        """The ids of each text, 32 bits each. Texts are taken in turn, a bounded number of bytes at once."""
        held: list[list[str | int]] = []
        n = 0
        for text in texts:
            held.append(self._pieces(text))
            n += len(text)
            if n > 4 << 20:
                yield from self._flush(held)
                held, n = [], 0
        yield from self._flush(held)

    def _flush(self, held: list[list[str | int]]) -> Iterator[np.ndarray]:
        if len(self.kept) > KEPT:
            self.kept = {}
        new = list({p for pieces in held for p in pieces if p not in self.kept})
        words = [p for p in new if isinstance(p, str)]
        self.kept.update({p: np.array([p], "<u4").tobytes() for p in new if not isinstance(p, str)})
        self.kept.update(zip(words, (x.astype("<u4").tobytes() for x in self.encode_pieces([w.encode("utf-8", "surrogatepass") for w in words])), strict=True))
        get = self.kept.__getitem__
        for pieces in held:
            yield np.frombuffer(b"".join(map(get, pieces)), "<u4")


_made: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder in each Python process."""
    if path not in _made:
        _made[path] = Encoder(Vocabulary(path), path)
    return _made[path]


def decode(v: Vocabulary, ids: np.ndarray) -> str:
    """Text of the ids; bytes that are not UTF-8 become U+FFFD, and special tokens stay."""
    tokens = v.tokens
    return b"".join([tokens[i] for i in ids.tolist()]).decode("utf-8", "replace")


def encode_decode(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, text) -> (doc_id, n_tokens, ids_sha256, decoded_sha256), one row per row.

    ids_sha256 is taken over the decimal ids joined by commas, decoded_sha256 over the decoded text in UTF-8. A null
    text counts as empty and has no ids. ``path`` names a byte-level BPE file that every executor can read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path)
        decimal = e.v.decimal
        for b in batches:
            n, ids_sha, text_sha = [], [], []
            for ids in e.encode_batch([t or "" for t in b.column(1).to_pylist()]):
                n.append(len(ids))
                ids_sha.append(hashlib.sha256(",".join([decimal[i] for i in ids.tolist()]).encode()).hexdigest())
                text_sha.append(hashlib.sha256(decode(e.v, ids).encode()).hexdigest())
            yield pa.record_batch({"doc_id": b.column(0), "n_tokens": pa.array(n, pa.int64()), "ids_sha256": pa.array(ids_sha, pa.string()), "decoded_sha256": pa.array(text_sha, pa.string())})

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
