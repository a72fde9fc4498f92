"""Secrets in texts: fixed patterns, and random strings by token efficiency.

A public byte-pair vocabulary covers words and names with few tokens, random strings with many: a run of key characters
with few characters a token is taken for a secret, after known digests (hex of a digest's length, UUIDs) and
identifiers (parts that are plain words or short numbers, numbers alone) are excluded. A part of an identifier that is
as long as a run must itself have many characters a token, else it is no word. Pattern matches always stay.

Edge cases: a null text is an empty one; texts of any length are read whole; repeated rows, and ties of doc_id, each get
a row; an empty table gives an empty result; other columns are ignored (kept by redact_secrets).
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from gaugework.llm.common import give_back, small_batches, texts
from gaugework.llm.spans import Covered, Span, joined, replaced, sha256

#: The kinds in their order, and the pattern of each.
KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(
    r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
    r"[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)
ACCESS, HEX = re.compile(r"AKIA[A-Z0-9]{16,}"), re.compile(r"[0-9a-f]{24,}")
#: Where an assignment can start, in a lower-cased text, and strings of which such a text has one.
WORD, HINTS = re.compile("password|passwd|secret|token|api_?key"), ("passw", "secret", "token", "apikey", "api_key")
RUN = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}")
UUID = re.compile(r"[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}")
DIGEST = re.compile(r"[0-9a-f]+|[0-9A-F]+")
DIGEST_LENGTHS = (32, 40, 56, 64, 96, 128)
SEPARATORS = re.compile(r"[+/_=-]+")
PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]{1,4}")


def assignments(text: str) -> list[Span]:
    low = text.lower()
    if not any(h in low for h in HINTS):
        return []
    if len(low) != len(text):  # a letter that is two in lower case
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    found, at = [], 0
    while word := WORD.search(low, at):
        if m := ASSIGN.match(text, word.start()):
            if len(m[2]) >= 6:
                found.append(("assign", *m.span()))
            at = m.end()
        else:
            at = word.start() + 1
    return found


def base_spans(text: str) -> list[Span]:
    access = [("access", *m.span()) for m in ACCESS.finditer(text)]
    return [*assignments(text), *access, *(("hex", *m.span()) for m in HEX.finditer(text))]


@functools.cache
def vocabulary(path: str):
    """A tiktoken encoding from a file of ranks, once for each Python worker."""
    import base64

    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def is_digest(run: str) -> bool:
    return bool(UUID.fullmatch(run) or (DIGEST.fullmatch(run) and len(run) in DIGEST_LENGTHS))


def is_known(run: str) -> bool:
    """Digests and identifiers, which are no secrets."""
    if is_digest(run):
        return True
    letters, digits = any(c.isalpha() for c in run), any(c.isdigit() for c in run)
    if not (letters and digits):
        return True
    parts = [p for p in SEPARATORS.split(run) if p]
    # an identifier: words of some length, with short numbers at most
    return all(PART.fullmatch(p) or (p.isalnum() and all(len(x) > 2 or x.isdigit() for x in PART.findall(p)) and "".join(PART.findall(p)) == p) for p in parts)


def random_spans(text: str, base: list[Span], path: str, most: float = 2.2, most_word: float = 2.1) -> list[Span]:
    """Runs of key characters with ``most`` or fewer characters a token; of identifiers, with a part of 20 or more characters at ``most_word`` or fewer."""
    found, taken = [], Covered(base)
    for m in RUN.finditer(text):
        run = m[0]
        if is_digest(run) or taken.meets(*m.span()):
            continue
        parts, limit = ([p for p in SEPARATORS.split(run) if len(p) >= 20 and not p.isdigit()], most_word) if is_known(run) else ([run], most)
        if any(len(p) <= limit * len(vocabulary(path).encode_ordinary(p)) for p in parts):
            found.append(("random", *m.span()))
    return found


def all_spans(text: str, path: str) -> tuple[list[Span], list[Span]]:
    base = base_spans(text)
    return base, random_spans(text, base, path)


def find_secrets(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, n_random, base_sha256, spans. path: a file of token ranks."""
    small_batches(docs.sparkSession)
    names = ["doc_id", "n_assign", "n_access", "n_hex", "n_random", "base_sha256", "spans"]
    types = [pa.int64()] * 5 + [pa.string()] * 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                base, more = all_spans(text, path)
                count = [sum(k == kind for k, *_ in [*base, *more]) for kind in KINDS]
                out.append((doc_id, *count, sha256(joined(base, KINDS)), joined(base + more, KINDS)))
            columns = zip(*out, strict=True) if out else [[] for _ in names]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, types, strict=True)], names)

    return texts(docs, "doc_id").mapInArrow(
        run, "doc_id long, n_assign long, n_access long, n_hex long, n_random long, base_sha256 string, spans string"
    )


def redact_secrets(docs: DataFrame, path: str, mark: str = "[SECRET]") -> DataFrame:
    """The documents with every secret in the text replaced by a mark, and n_chars, if there is one, brought up to date."""
    small_batches(docs.sparkSession)
    at, n_chars = docs.columns.index("text"), docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            old = b.column(at).to_pylist()
            new = [t and replaced(t, [s for part in all_spans(t, path) for s in part], mark) for t in old]
            columns = list(b.columns)
            columns[at] = pa.array(new, b.schema.field(at).type)
            if n_chars is not None:
                sizes = [n if x == y else len(y) for n, x, y in zip(columns[n_chars].to_pylist(), old, new, strict=True)]
                columns[n_chars] = pa.array(sizes, b.schema.field(n_chars).type)
            yield pa.RecordBatch.from_arrays(columns, b.schema.names)
        give_back()

    return docs.mapInArrow(run, docs.schema)
