"""Byte-level BPE by backtracking, and decoding through an offset table.

A text is cut into pieces as the vocabulary's pre-tokenizer does; no merge crosses a piece. In a piece, Aho-Corasick
over the reversed bytes gives the longest token that starts at each place. A sequence of tokens is the one BPE makes
just when every two neighbours fit, that is when BPE would not have merged across their border before it had made
both. So tokens are taken longest first, checked against the one before, shortened to the next token that is a prefix
where they don't fit, and taken back where none does; a place once left is never entered again, so the work is linear
in the piece. Which pairs fit is kept in a table.

Defined results: a null text is an empty one and has no tokens; strings of added tokens in a text become these
tokens; rows that repeat are each encoded; a null doc_id stays null; other columns are not read; an empty table gives
no rows. Vocabularies that need more than this (a normalizer, prefix spaces, added tokens that strip white space)
raise ValueError.
"""

from __future__ import annotations

import hashlib
import json
import re
import struct
import sys
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import table

#: The pattern of the pre-tokenizer for texts whose characters Python and the library class alike.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+"
#: Pieces and pairs remembered at most, in each worker; pieces longer than LONG are not remembered.
REMEMBERED, LONG = 600_000, 64
#: Ids decoded at once.
DECODED = 1 << 16
_NEVER = 1 << 40


def byte_letters() -> dict[str, int]:
    """The characters that stand for bytes in the vocabulary file: printable bytes for themselves, others from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


def _odd() -> np.ndarray:
    """By code point: Python's patterns may class it otherwise than the library, as a number that is no digit, a separator
    of records, or a character that Python's table doesn't know."""
    return np.array([unicodedata.category(chr(c)) in ("Nl", "No", "Cn") or 0x1C <= c <= 0x1F for c in range(sys.maxunicode + 1)])


class Vocabulary:
    """Tokens and merges of a byte-level BPE file, as plain tables of a fixed size; what tasks need besides is built in
    them once for each worker."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, pre = spec["model"], spec.get("pre_tokenizer") or {}
        wants = {"normalizer": spec.get("normalizer"), "post_processor": spec.get("post_processor"), "prefix space": pre.get("add_prefix_space"), "dropout": model.get("dropout"), "prefix": model.get("continuing_subword_prefix"), "suffix": model.get("end_of_word_suffix")}
        if model["type"] != "BPE" or pre.get("type") != "ByteLevel" or not pre.get("use_regex", True) or any(wants.values()):
            raise ValueError(f"not a plain byte-level BPE vocabulary: {path}")
        letters = byte_letters()
        self.tokens: dict[bytes, int] = {bytes(letters[c] for c in t): i for t, i in model["vocab"].items()}
        n = 1 + max([*self.tokens.values(), *(a["id"] for a in spec["added_tokens"])])
        #: the order in which merges were learned (-1: a single byte), and the two tokens each was made of
        self.made, self.left, self.right = [-1] * n, [-1] * n, [-1] * n
        self.across: dict[int, int] = {}
        for rank, merge in enumerate(model["merges"]):
            a, b = (bytes(letters[c] for c in part) for part in (merge.split(" ") if isinstance(merge, str) else merge))
            ab, a, b = self.tokens[a + b], self.tokens[a], self.tokens[b]
            self.made[ab], self.left[ab], self.right[ab] = rank, a, b
            self.across[a * n + b] = rank
        self.n = n
        self.added = {}
        for t in spec["added_tokens"]:
            if t["lstrip"] or t["rstrip"] or t["single_word"]:
                raise ValueError(f"added token {t['content']!r} of {path} strips or keeps to words")
            self.added[t["content"]] = t["id"]
        spelled = {i: t for t, i in self.tokens.items()} | {i: t.encode() for t, i in self.added.items()}
        self.bytes = np.frombuffer(b"".join(spelled.get(i, b"") for i in range(n)), np.uint8)
        self.offsets = np.cumsum([0, *(len(spelled.get(i, b"")) for i in range(n))])
        self._coder = None

    def coder(self) -> Coder:
        if self._coder is None:
            self._coder = Coder(self)
        return self._coder

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_coder": None}


def backward_automaton(tokens: dict[bytes, int]) -> tuple[dict[int, int], list[int], list[int]]:
    """Aho-Corasick over the reversed tokens: the state after a state and a byte (state * 256 + byte), the state to fall back
    to, and the longest token that ends, read backwards, in each state (-1: none)."""
    step, fall, longest = {}, [0], [-1]
    for token, i in tokens.items():
        state = 0
        for byte in reversed(token):
            edge = state << 8 | byte
            state = step.get(edge)
            if state is None:
                state = step[edge] = len(fall)
                fall.append(0)
                longest.append(-1)
        longest[state] = i
    level = [(0, edge & 255, to) for edge, to in step.items() if edge < 256]
    children: dict[int, list[tuple[int, int]]] = {}
    for edge, to in step.items():
        children.setdefault(edge >> 8, []).append((edge & 255, to))
    while level:
        below = []
        for parent, byte, state in level:
            if parent:
                at = fall[parent]
                while at and (at << 8 | byte) not in step:
                    at = fall[at]
                fall[state] = step.get(at << 8 | byte, 0)
            if longest[state] < 0:
                longest[state] = longest[fall[state]]
            below += [(state, b, to) for b, to in children.get(state, ())]
        level = below
    return step, fall, longest


class _Steps(dict):
    """The state after state * 256 + byte; steps that fall back first are remembered as they are met."""

    def __init__(self, step: dict[int, int], fall: list[int]):
        super().__init__(step)
        self.fall, self.most = fall, len(step) + REMEMBERED

    def __missing__(self, edge: int) -> int:
        state, byte, to = edge >> 8, edge & 255, None
        while to is None and state:
            state = self.fall[state]
            to = self.get(state << 8 | byte)
        if len(self) < self.most:
            self[edge] = to or 0
        return to or 0


class Coder:
    """Encodes and decodes with one vocabulary."""

    def __init__(self, v: Vocabulary):
        self.v, self.length = v, np.diff(v.offsets).tolist()
        step, fall, self.longest = backward_automaton(v.tokens)
        self.step = _Steps(step, fall)
        self.shorter = [-1] * v.n
        for token, i in v.tokens.items():
            self.shorter[i] = next((v.tokens[token[:k]] for k in range(len(token) - 1, 0, -1) if token[:k] in v.tokens), -1)
        self.fitting: dict[int, bool] = {}
        self.known: dict[str, bytes] = {}
        self.pieces, self.odd = re.compile(PIECES), _odd()
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(v.added, key=len, reverse=True))) + ")") if v.added else None

    def fits(self, a: int, b: int) -> bool:
        """No merge across the border of a and b comes before both are made: the parts that touch there are followed back,
        the one made last is undone first (of equal ones the right, as BPE merges from the left)."""
        v, key, before, fit = self.v, a * self.v.n + b, _NEVER, True
        while fit:
            fit = v.across.get(a * v.n + b, _NEVER) >= before
            if v.made[a] > v.made[b]:
                before, a = v.made[a], v.right[a]
            elif v.made[b] >= 0:
                before, b = v.made[b] + 1, v.left[b]
            else:
                break
        if len(self.fitting) >= REMEMBERED:
            self.fitting.clear()
        self.fitting[key] = fit
        return fit

    def tokens_of(self, piece: bytes) -> list[int]:
        """The tokens BPE makes of a piece."""
        whole = self.v.tokens.get(piece)
        if whole is not None:
            return [whole]
        step, ending, state, longest = self.step, self.longest, 0, []
        for byte in reversed(piece):
            state = step[state << 8 | byte]
            longest.append(ending[state])
        length, shorter, fitting, size = self.length, self.shorter, self.fitting.get, self.v.n
        out, at, last, left = [], 0, len(piece) - 1, set()
        token = longest[last]
        while at <= last:
            while token >= 0:
                end = at + length[token]
                if end not in left:
                    fit = not out or fitting(out[-1] * size + token)
                    if fit or fit is None and self.fits(out[-1], token):
                        out.append(token)
                        at = end
                        token = longest[last - at] if at <= last else -1
                        break
                token = shorter[token]
            else:
                left.add(at)
                if not out:
                    raise ValueError("a byte of the text is no token of the vocabulary")
                token = out.pop()
                at -= length[token]
                token = shorter[token]
        return out

    def _packed(self, piece: str) -> bytes:
        ids = self.tokens_of(piece.encode())
        ids = struct.pack(f"<{len(ids)}I", *ids)
        if len(piece) <= LONG:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            self.known[piece] = ids
        return ids

    def _split(self, text: str) -> list[str]:
        if not any(self.odd[np.frombuffer(text[k : k + DECODED].encode("utf-32-le"), np.uint32)].any() for k in range(0, len(text), DECODED)):
            return self.pieces.findall(text)
        from tokenizers import pre_tokenizers

        found = pre_tokenizers.ByteLevel(add_prefix_space=False).pre_tokenize_str(text)
        return [text[a:b] for _, (a, b) in found]

    def encode(self, text: str) -> bytes:
        """The ids of a text as little-endian unsigned 32-bit integers."""
        get, out = self.known.get, []
        for k, part in enumerate(self.cut.split(text) if self.cut else [text]):
            if k % 2:
                out.append(self.v.added[part].to_bytes(4, "little"))
            elif part:
                out += [get(p) or self._packed(p) for p in self._split(part)]
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        """The text of ids: the bytes of each are copied from its place in the table; what is no UTF-8 is replaced."""
        ids, parts = np.frombuffer(ids, "<u4"), []
        for k in range(0, len(ids), DECODED):
            some = ids[k : k + DECODED]
            start, size = self.v.offsets[some], self.v.offsets[some + 1] - self.v.offsets[some]
            ends = np.cumsum(size)
            parts.append(self.v.bytes[np.arange(ends[-1]) + np.repeat(start - ends + size, size)].tobytes())
        return b"".join(parts).decode("utf-8", "replace")


def _coded(vocabulary, keep_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = vocabulary.value.coder()
        sha = lambda b: hashlib.sha256(b).hexdigest()
        for whole in batches:
            for first in range(0, whole.num_rows, 256):
                batch = whole.slice(first, 256)
                n, ids_sha, text_sha, kept = [], [], [], []
                for text in batch.column("text"):
                    ids = coder.encode(text.as_py() or "")
                    n.append(len(ids) // 4)
                    if keep_ids:
                        kept.append(np.frombuffer(ids, "<u4").astype(np.int32))
                    else:
                        ids_sha.append(sha(ids))
                        text_sha.append(sha(coder.decode(ids).encode()))
                more = {"ids": pa.array(kept, pa.list_(pa.int32()))} if keep_ids else {"ids_sha256": pa.array(ids_sha, pa.string()), "decoded_sha256": pa.array(text_sha, pa.string())}
                yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "n_tokens": pa.array(n, pa.int64())} | more)

    return run


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids (array of int): the tokens of every whole text by the vocabulary file at path, which the
    driver reads; its tables, of fixed size, are broadcast."""
    vocabulary = docs.sparkSession.sparkContext.broadcast(Vocabulary(path))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(_coded(vocabulary, True), f"doc_id {kind}, n_tokens long, ids array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id, text: encode() undone; null ids give a null text."""
    vocabulary = encoded.sparkSession.sparkContext.broadcast(Vocabulary(path))
    kind = encoded.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = vocabulary.value.coder()
        for batch in batches:
            texts = [None if not ids.is_valid else coder.decode(np.array(ids.as_py(), "<u4").tobytes()) for ids in batch.column("ids")]
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "text": pa.array(texts, pa.string())})

    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, text string")


def digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: digests of each text's ids and of what these decode to."""
    vocabulary = docs.sparkSession.sparkContext.broadcast(Vocabulary(path))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(_coded(vocabulary, False), f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op13_bpe(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    import public_tokenizers

    return digests(table(spark, sf_dir, "documents"), path or public_tokenizers.path("byte_bpe_50k.json"))
