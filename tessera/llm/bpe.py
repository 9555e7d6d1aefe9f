"""Byte-level BPE encoding and decoding by speculation.

A text is cut into words by the tokenizer's own pattern. For words not met before, greedy longest match proposes tokens;
all adjacent pairs of a batch's proposals are then checked at once against a growing table of pairs (compatible: the two
tokens' bytes encode to just these two). Where every pair of a word is compatible, the proposal is the exact encoding;
only the other words undergo merging in order of rank. Words already met are looked up. The vocabulary file is a parameter
and is read where the tasks run.

Defined cases: a null or empty text has no ids and decodes to an empty text; a null doc_id stays null; repeated rows give
repeated rows; an empty table gives an empty result; text that spells a special token gets that token's id.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re
from collections.abc import Iterator
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

#: The pattern of byte-level tokenizers, in full and for texts in which Python's faster module agrees.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PLAIN_PATTERN = r"'(?:[stmd]|re|ve|ll)| ?[^\W\d_]+| ?[0-9]+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+"
#: Any character outside tab to \r, printable ASCII and Latin letters and signs (no superscript digits, no fractions).
NOT_PLAIN = "[^\t-\r\x20-\x7e\xa0-\xb1\xb4-\xb8\xba\xbb\xbf-ɏ]"
#: Words remembered in one Python worker, and table size at which the memory starts again.
REMEMBERED = 300_000


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in the vocabulary file: printable bytes are themselves, the others follow 255."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


class Tokenizer:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        letters = byte_letters()
        as_bytes = lambda token: bytes(map(letters.__getitem__, token))
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.ids = {as_bytes(t): i for t, i in spec["model"]["vocab"].items() if t not in self.special}
        self.size = 1 + max([*self.ids.values(), *self.special.values()])
        self.bytes = [b""] * self.size
        for token, i in self.ids.items():
            self.bytes[i] = token
        for text, i in self.special.items():
            self.bytes[i] = text.encode()
        self.names = [str(i) for i in range(self.size)]
        self.lengths = np.array([len(b) for b in self.bytes])
        # ids rise with the merges' ranks in such files, so the library merges in the file's order
        self.merger = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=self.ids, special_tokens={})
        self.matcher = ahocorasick.Automaton()
        for token, i in self.ids.items():
            self.matcher.add_word(token.decode("latin-1"), i)
        self.matcher.make_automaton()
        self.full, self.plain, self.not_plain = regex.compile(PATTERN), re.compile(PLAIN_PATTERN), re.compile(NOT_PLAIN)
        self.cut = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.known: dict[str, list[int]] = {}
        self.codes, self.good = np.empty(0, np.int64), np.empty(0, bool)

    def merged(self, word: bytes) -> list[int]:
        """The exact encoding, by merging: the pair whose token has the lowest rank first, the leftmost of equal ones."""
        return self.merger._encode_single_piece(word)

    def proposed(self, raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Greedy longest match in all words at once: the tokens and the word of each."""
        joined = "Ā".join([w.decode("latin-1") for w in raw])  # a letter that is no byte parts the words
        found = np.array(list(self.matcher.iter_long(joined)), np.int64).reshape(-1, 2)
        ends = np.cumsum(np.fromiter((len(w) + 1 for w in raw), np.int64, len(raw)))
        return found[:, 1], np.searchsorted(ends, found[:, 0], side="right")

    def compatible(self, codes: np.ndarray) -> np.ndarray:
        """For pairs (first id * size + second id), or single tokens (-1 - id): does merging give just these back?"""
        asked, back = np.unique(codes, return_inverse=True)
        new = asked[~np.isin(asked, self.codes, assume_unique=True)] if len(self.codes) else asked
        if len(new):
            pairs = [((-1 - c,) if c < 0 else divmod(c, self.size)) for c in new.tolist()]
            good = np.array([self.merged(b"".join(self.bytes[i] for i in p)) == list(p) for p in pairs], bool)
            every = np.concatenate([self.codes, new])
            order = np.argsort(every)
            self.codes, self.good = every[order], np.concatenate([self.good, good])[order]
        return self.good[np.searchsorted(self.codes, asked)][back]

    def learn(self, words: list[str]) -> None:
        raw = [w.encode() for w in words]
        flat, owner = self.proposed(raw)
        lengths = np.bincount(owner, minlength=len(words))
        inner = owner[:-1] == owner[1:]
        alone = lengths == 1
        codes = np.concatenate([(flat[:-1] * self.size + flat[1:])[inner], -1 - flat[alone[owner]]])
        owners = np.concatenate([owner[:-1][inner], owner[alone[owner]]])
        whole = np.bincount(owner, self.lengths[flat], len(words)) == np.fromiter(map(len, raw), np.int64, len(raw))
        failing = {*np.unique(owners[~self.compatible(codes)]).tolist(), *np.flatnonzero(~whole).tolist()}
        ids, ends = flat.tolist(), np.cumsum(lengths).tolist()
        for i, (word, end, length) in enumerate(zip(words, ends, lengths.tolist(), strict=True)):
            self.known[word] = self.merged(raw[i]) if i in failing else ids[end - length : end]

    def words(self, text: str) -> list[str]:
        return (self.full if self.not_plain.search(text) else self.plain).findall(text)

    def encode(self, texts: list[str]) -> Iterator[list[int]]:
        parts = [self.cut.split(t) if self.cut else [t] for t in texts]  # odd places: special tokens
        cut = [[self.words(p) if i % 2 == 0 else p for i, p in enumerate(ps)] for ps in parts]
        if len(self.known) > REMEMBERED:
            self.known.clear()
            self.codes, self.good = np.empty(0, np.int64), np.empty(0, bool)
        new = set().union(*(p for ps in cut for p in ps[::2])).difference(self.known)
        if new:
            self.learn(list(new))
        for ps in cut:
            out: list[int] = []
            for i, p in enumerate(ps):
                if i % 2:
                    out.append(self.special[p])
                else:
                    out.extend(chain.from_iterable(map(self.known.__getitem__, p)))
            yield out

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.bytes.__getitem__, ids)).decode("utf-8", "replace")


@functools.lru_cache(maxsize=2)
def tokenizer(path: str) -> Tokenizer:
    """One per Python worker and file."""
    return Tokenizer(path)


def _mapped(docs: DataFrame, path: str, per_text, schema: str) -> DataFrame:
    """per_text(tokenizer, ids) gives the columns after doc_id. Texts go through in blocks of about a million characters."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = tokenizer(path)
        for batch in it:
            texts, at = [t or "" for t in batch.column(1).to_pylist()], 0
            while at < len(texts):
                to, chars = at, 0
                while to < len(texts) and (to == at or chars < 1_000_000):
                    chars += len(texts[to])
                    to += 1
                rows = [per_text(own, ids) for ids in own.encode(texts[at:to])]
                columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0)[at:to], *columns], names=names)
                at = to

    fields = T.StructType.fromDDL(schema)
    names, types = fields.names, [to_arrow_type(f.dataType) for f in fields[1:]]
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string")).mapInArrow(batches, schema)


def encoded(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids: the token ids of every text."""
    return _mapped(docs, path, lambda own, ids: (ids,), "doc_id bigint, ids array<int>")


def encoded_digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: every text encoded and decoded again, as digests."""

    def digests(own: Tokenizer, ids: list[int]) -> tuple[int, str, str]:
        listed = ",".join(map(own.names.__getitem__, ids))
        return len(ids), hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(own.decode(ids).encode()).hexdigest()

    return _mapped(docs, path, digests, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")


def decoded(tokens: DataFrame, path: str) -> DataFrame:
    """doc_id, text from doc_id, ids."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = tokenizer(path)
        for batch in it:
            texts = [own.decode(ids or []) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return tokens.select("doc_id", "ids").mapInArrow(batches, "doc_id bigint, text string")
