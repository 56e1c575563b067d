"""Byte-level BPE encoding and decoding with a local vocabulary.

A long text is parted at safe boundaries: a space whose neighbours are both no white space always starts a match of
the pre-splitting pattern, and no match crosses it, so the parts' ids put one after another are the text's ids.
Very long runs of white space, on which the pattern's look-ahead would overflow the library's stack, are matched here, by
the pattern's own rule: a run is one match, without its last character unless the text ends there.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import mapped

#: A safe boundary: one space between two characters that are no white space.
SAFE = re.compile(r"(?<=\S) (?=\S)")
#: Characters of a part, up to the next safe boundary; those of a run of white space that the pattern does not see.
PART, RUN = 100_000, 10_000
# The characters that the pattern's \s stands for.
WHITE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: A text that is empty or has a space that may be no safe boundary.
UNSAFE = f"^[{WHITE}]|[{WHITE}]{{2}}|[{WHITE}]$|^$"


def parts(text: str) -> list[str]:
    """A long text parted at safe boundaries; each part but the first starts with its space."""
    out, at = [], 0
    while len(text) - at > PART and (m := SAFE.search(text, at + PART)):
        out.append(text[at : m.start()])
        at = m.start()
    return [*out, text[at:]]


class Coder:
    """encode(text) -> the ids, as unsigned 32-bit numbers. special: strings that stand for an id wherever they occur."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, special: dict[str, int] | None = None):
        import tiktoken

        # A name for a special token that is never allowed is never special; without any, each character is tried for one.
        self.encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={"<|never|>": max(ranks.values()) + 1})
        self.special = special or {}
        self.table = {i: b for b, i in ranks.items()} | {i: x.encode() for x, i in self.special.items()}
        self.at_special = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.run = re.compile(f"[{WHITE}]{{{RUN},}}")

    def encode(self, text: str) -> np.ndarray:
        if self.at_special is None or not self.at_special.search(text):
            return self._ordinary(text)
        out, at = [], 0
        for m in self.at_special.finditer(text):
            out += [self._ordinary(text[at : m.start()]), np.array([self.special[m[0]]], np.uint32)]
            at = m.end()
        return np.concatenate([*out, self._ordinary(text[at:])])

    @cached_property
    def sizes(self) -> np.ndarray:
        """The bytes of each id."""
        out = np.zeros(max(self.table) + 1, np.int64)
        out[list(self.table)] = [len(b) for b in self.table.values()]
        return out

    def encode_all(self, texts: pa.Array) -> list[np.ndarray]:
        """encode(text) for each of texts. Where all its spaces are safe boundaries, what stands between two of them is encoded
        once, however often these texts hold it."""
        texts = texts.cast(pa.string())
        whole = pc.match_substring_regex(texts, UNSAFE).to_numpy(zero_copy_only=False) | (self.at_special is not None)
        out = np.empty(len(texts), object)
        for i in np.flatnonzero(whole):
            out[i] = self.encode(texts[i].as_py())
        if whole.all():
            return out.tolist()
        found = pc.split_pattern(texts.filter(pa.array(~whole)), " ")
        pieces, ends = found.flatten(), found.offsets.to_numpy()
        coded = pieces.dictionary_encode()
        ids = self._ordinary(" " + pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(coded.dictionary)], pa.int32()), coded.dictionary), " ")[0].as_py())
        upto = np.searchsorted(np.cumsum(self.sizes[ids]), np.cumsum(pc.binary_length(coded.dictionary).to_numpy() + 1)) + 1
        first = [self._ordinary(x) for x in pieces.take(pa.array(ends[:-1])).to_pylist()]  # no space stands before these
        size = np.diff(np.concatenate((upto, len(ids) + np.cumsum([len(x) for x in first]))), prepend=0)
        start, at = np.cumsum(size) - size, coded.indices.to_numpy().astype(np.int64)
        at[ends[:-1]] = len(upto) + np.arange(len(first))
        n = size[at]
        done = np.cumsum(n)
        held = np.concatenate((ids, *first))[np.repeat(start[at] - done + n, n) + np.arange(done[-1])]
        for i, x in zip(np.flatnonzero(~whole), np.split(held, done[ends[1:-1] - 1])):
            out[i] = x
        return out.tolist()

    def _ordinary(self, text: str) -> np.ndarray:
        if len(text) <= PART:
            return self._part(text)
        return np.concatenate([self._part(x) for x in parts(text)])

    def _part(self, text: str) -> np.ndarray:
        if len(text) <= RUN:
            return self.encoding.encode_to_numpy(text, disallowed_special=())
        out, at = [], 0
        for m in self.run.finditer(text):
            end = m.end() if m.end() == len(text) else m.end() - 1
            out += [self.encoding.encode_to_numpy(text[at : m.start()], disallowed_special=()), np.array(self.encoding._encode_single_piece(m[0][: end - m.start()].encode()), np.uint32)]
            at = end
        return np.concatenate([*out, self.encoding.encode_to_numpy(text[at:], disallowed_special=())])

    def decode(self, ids: np.ndarray) -> bytes:
        """The raw bytes of ids; they need not be valid UTF-8."""
        return b"".join(map(self.table.__getitem__, ids.tolist()))


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def read_vocabulary(path: str) -> dict[bytes, int]:
    """The ranks in a tokenizers file of a byte-level BPE: its ids are in the order of its merges."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(shown))}
    with open(path, encoding="utf-8") as f:
        held = json.load(f)
    special = special_tokens(path)
    return {bytes(byte[c] for c in token): i for token, i in held["model"]["vocab"].items() if token not in special}


def special_tokens(path: str) -> dict[str, int]:
    """The added tokens of a tokenizers file, which stand for themselves wherever a text holds them."""
    with open(path, encoding="utf-8") as f:
        return {x["content"]: x["id"] for x in json.load(f).get("added_tokens", [])}


@lru_cache(maxsize=2)
def coder_of(path: str, pattern: str) -> Coder:
    """A coder by the tiktoken library from a rank file, without special tokens, or from a tokenizers file, with its own."""
    if path.endswith(".json"):
        return Coder(read_vocabulary(path), pattern, special_tokens(path))
    return Coder(read_ranks(path), pattern)


def encode_documents(documents: DataFrame, path, pattern: str, text: str = "text", ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row, and with ``ids`` the ids as an array.

    path() or path is the rank file, looked up where the task runs. A null text is an empty one: no ids, the hashes of
    no bytes. Texts of any length are encoded whole; repeated rows are encoded alike; other columns are not read."""

    def run(batches):
        coder = coder_of(path() if callable(path) else path, pattern)
        for b in batches:
            n, own, raw, held = [], [], [], []
            for x in b.column("text").to_pylist():
                got = coder.encode(x or "")
                n.append(len(got))
                own.append(hashlib.sha256(got.astype("<u4").tobytes()).hexdigest())
                raw.append(hashlib.sha256(coder.decode(got)).hexdigest())
                if ids:
                    held.append(got.astype(np.int32))
            columns = [b.column("doc_id"), pa.array(n, pa.int64()), pa.array(own), pa.array(raw)] + ([pa.array(held, pa.list_(pa.int32()))] if ids else [])
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids"] * ids)

    kept = documents.select("doc_id", F.col(text).alias("text"))
    kind = dict(kept.dtypes)["doc_id"]
    return mapped(kept, run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * ids)
