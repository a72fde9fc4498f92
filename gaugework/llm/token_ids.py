"""Token ids of whole texts by a file of the tokenizers library, fast where words come again.

The vocabularies split a text into runs of letters, of digits and of marks, and encode each run by itself. For texts of
Latin letters, digits and common marks, numpy finds these runs in the UTF-8 bytes of many texts at once, Arrow finds the
distinct ones, and the library encodes those that are new, many in one call; a bounded memo keeps them. Texts with anything else (other
letters, apostrophes, runs of white space, strings of special tokens) are encoded as they are.
"""

from __future__ import annotations

import functools
import os
from collections.abc import Iterable

import numpy as np
import pyarrow as pa

OTHER, LETTER, DIGIT, MARK, SPACE, FEED, END = range(7)
#: Runs with more bytes than this are encoded each time and not kept, so that the memo's bytes are bounded too.
LONGEST = 64


@functools.cache
def classes() -> np.ndarray:
    """The class of every byte; of bytes over 127, only the lead and the rest of U+00C0 to U+00FF can be letters."""
    out = np.full(256, OTHER, np.uint8)
    for kind, chars in (
        (LETTER, range(65, 91)), (LETTER, range(97, 123)), (LETTER, [0xC3, *range(0x80, 0xC0)]), (DIGIT, range(48, 58)),
        (MARK, b"!\"#$%&()*+,./:;=<>?@[\\]^_`{|}~-"), (SPACE, b" "), (FEED, b"\n"), (END, b"\0")
    ):
        out[list(chars)] = kind
    return out


class TokenIds:
    """keep_space: a space belongs to the run after it. Otherwise texts are lower-cased, digits stand alone, white space goes."""

    def __init__(self, path: str, keep_space: bool, memo: int = 200_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.keep_space, self.limit = Tokenizer.from_file(path), keep_space, memo
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}
        names = self.tokenizer.get_vocab()
        ends = self.singly(["\n"]) if keep_space else [np.array([i for w, i in names.items() if w.endswith("</w>")], "<u4").tobytes()]
        self.last = np.zeros(1 + max(names.values()), bool)  # of each id, whether it ends a run (or is the mark behind it)
        self.last[np.frombuffer(ends[0], "<u4")] = True

    def runs(self, texts: list[str]) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """All runs of all texts, an end run after each; the places of the end runs; which texts are not made of such runs alone."""
        data = bytearray("\0".join([*texts, ""]).encode())
        x = np.frombuffer(data, np.uint8)
        kind = classes()[x]
        after_lead = np.append(False, x[:-1] == 0xC3)
        rest = (x & 0xC0) == 0x80
        odd = (kind == OTHER) | (rest != after_lead) | (rest & ((x == 0x97) | (x == 0xB7)))
        odd[1:] |= (x[:-1] == 60) & (x[1:] == 124)  # <|
        if self.keep_space:
            white = (kind == SPACE) | (kind == FEED)
            odd[1:] |= white[:-1] & (white[1:] | (kind[1:] == END))
        else:
            x[(x >= 65) & (x <= 90)] += 32
            x[after_lead & (x < 0x9F)] += 32
        starts = np.ones(len(x), bool)
        starts[1:] = kind[1:] != kind[:-1]
        if self.keep_space:
            starts[1:] &= (kind[:-1] != SPACE) | (kind[1:] == END)
        else:
            starts |= kind == DIGIT
        ends = kind == END
        starts |= ends
        at = np.flatnonzero(starts)
        stops = np.flatnonzero(ends)
        bad = np.logical_or.reduceat(odd, np.append(0, stops[:-1] + 1)) if len(stops) else np.zeros(0, bool)
        offsets = np.append(at, len(x)).astype(np.int32)
        found = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
        return found, np.flatnonzero(ends[at]), bad

    def singly(self, runs: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(runs, add_special_tokens=False)]

    def coded(self, runs: list[bytes]) -> list[bytes]:
        """The ids of each run. Runs go to the library joined by a separator that it takes apart again: a line feed, which
        is an id of its own, or a space, which gives none where every run's last id ends a word."""
        joint, out = [k for k, r in enumerate(runs) if r.strip()], [b""] * len(runs)
        mark = b"\n" if self.keep_space else b" "
        for at in range(0, len(joint), 4096):
            now = joint[at : at + 4096]
            text = b"".join(runs[k] + mark for k in now).decode()
            ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
            last = np.flatnonzero(self.last[ids])
            raw, ends = ids.tobytes(), (4 * last + 4).tolist()
            if len(ends) != len(now):
                raise ValueError("a vocabulary that doesn't keep the runs apart")
            skip = 4 if self.keep_space else 0
            for k, a, z in zip(now, [0, *ends], ends, strict=False):
                out[k] = raw[a : z - skip]
        if self.keep_space and len(joint) < len(runs):
            white = [k for k, r in enumerate(runs) if not r.strip()]
            for k, ids in zip(white, self.singly([runs[k].decode() for k in white]), strict=True):
                out[k] = ids
        return out

    def looked_up(self, runs: list[bytes], used: np.ndarray) -> list[bytes]:
        """The ids of distinct runs, those that aren't used as none. The memo has two generations: what is met again in
        the old one moves to the new one; when the new one is full it becomes the old one, so that words of many texts stay."""
        if len(self.young) >= self.limit:
            self.young, self.old = {}, self.young
        young, old = self.young, self.old
        young[b"\0"] = b""  # an end run
        own = list(map(young.get, runs))
        new = []
        for k in [k for k, x in enumerate(own) if x is None]:
            x = old.get(runs[k])
            if x is None and used[k]:
                new.append(k)
            elif x is None:
                own[k] = b""
            else:
                own[k] = young[runs[k]] = x
        for k, x in zip(new, self.coded([runs[k] for k in new]), strict=True):
            own[k] = x
            if len(runs[k]) <= LONGEST:
                young[runs[k]] = x
        return own

    def encode(self, texts: Iterable[str]) -> list[bytes]:
        """For every text its ids as little-endian unsigned 32-bit integers."""
        texts = list(texts)
        plain = [t if "\0" not in t else None for t in texts]
        found, stops, bad = self.runs([t or "" for t in plain])
        distinct = found.dictionary_encode()
        index, (_, offsets, data) = distinct.indices.to_numpy(), distinct.dictionary.buffers()
        ends, data = np.frombuffer(offsets, np.int32)[: len(distinct.dictionary) + 1].tolist(), data.to_pybytes()
        runs = [data[a:z] for a, z in zip(ends, ends[1:], strict=False)]
        used = np.zeros(len(runs), bool)
        used[index[np.repeat(~bad, np.diff(stops, prepend=-1))]] = True
        own = self.looked_up(runs, used)
        flat, size = np.frombuffer(b"".join(own), "<u4"), np.fromiter(map(len, own), np.int64, len(own)) // 4
        first = np.cumsum(size) - size
        n = size[index]
        upto = np.cumsum(n)
        raw = flat[np.arange(upto[-1] if len(upto) else 0) + np.repeat(first[index] - (upto - n), n)].tobytes()
        cuts = (4 * upto[stops]).tolist()
        out = [raw[a:z] for a, z in zip([0, *cuts], cuts, strict=False)]
        for k in np.flatnonzero(bad | np.array([t is None for t in plain], bool)):
            out[k] = self.singly([texts[k]])[0]
        return out
