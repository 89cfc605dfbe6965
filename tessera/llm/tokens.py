"""Whole-text encoding with a byte-level BPE file of the tokenizers library, by the faster of two public encoders."""

from __future__ import annotations

import json
from functools import lru_cache

import numpy as np

from .bpe import SPLIT, byte_of_char


class FastEncoder:
    """Gives the ids that the tokenizers library gives with add_special_tokens=False."""

    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        to_byte = byte_of_char()
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        ids = {k: v for k, v in spec["model"]["vocab"].items() if k not in special}
        made = [ids["".join(m.split(" ")) if isinstance(m, str) else m[0] + m[1]] for m in spec["model"]["merges"]]
        if made != sorted(made):
            raise ValueError("ids do not follow the order of merges, as ranks must")
        ranks = {bytes(to_byte[c] for c in k): v for k, v in ids.items()}
        self.size = max([*ranks.values(), *special.values()]) + 1
        self.lengths = np.zeros(self.size, np.int64)
        for k, v in ranks.items():
            self.lengths[v] = len(k)
        for k, v in special.items():
            self.lengths[v] = len(k.encode())
        self._encoding = tiktoken.Encoding("bytes", pat_str=SPLIT.pattern, mergeable_ranks=ranks, special_tokens=special)

    def encode(self, text: str | None) -> np.ndarray:
        """Ids, 32 bits each; special tokens written in the text are found, as by the library."""
        return self._encoding.encode_to_numpy(text, allowed_special="all") if text else np.empty(0, np.uint32)


@lru_cache(4)
def fast_encoder(path: str) -> FastEncoder:
    """One encoder in each Python process."""
    return FastEncoder(path)
