"""BPE encoding and decoding in batched numpy merge rounds.

The symbols of many words lie in one flat array. In each round every word's lowest-ranked pair is found by binary search over the sorted
keys of the merge table, all its occurrences in that word are merged, and only the pairs beside a merge are looked up again.

The vocabulary file is a parameter: a word-level BPE as the ``tokenizers`` library stores it (normaliser NFC, white space to one space,
lower case; a Split pattern that drops the rest; bytes as printable characters; a suffix at the end of words).
"""

from __future__ import annotations

import functools
import hashlib
import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from tidewatch.llm.textcore import WordTable, kept, portions, trimmed

NO_RANK = np.iinfo(np.int32).max


def vocabulary_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_letters() -> list[str]:
    """The printable character that byte-level vocabularies write for each byte: printable Latin-1 stands for itself, the others are
    counted up from U+0100."""
    plain = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b]
    out, extra = [""] * 256, 0
    for b in range(256):
        if b in plain:
            out[b] = chr(b)
        else:
            out[b], extra = chr(256 + extra), extra + 1
    return out


class Bpe:
    """Encoder and decoder for one vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab: dict[str, int] = model["vocab"]
        self.size = max([*vocab.values(), *(t["id"] for t in spec["added_tokens"])]) + 1
        self.suffix = model["end_of_word_suffix"] or ""
        letters = byte_letters()
        self.plain = np.array([vocab[c] for c in letters], np.int32)
        self.ending = np.array([vocab[c + self.suffix] for c in letters], np.int32)
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        left, right = (np.array([vocab[m[k]] for m in merges], np.int64) for k in (0, 1))
        made = np.array([vocab[a + b] for a, b in merges], np.int32)
        keys = left * self.size + right
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.made = keys[order], order.astype(np.int32), made
        self.token = [b""] * self.size
        for text, i in vocab.items():
            self.token[i] = text.encode()
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for text, i in self.special.items():
            self.token[i] = text.encode()
        self.special_split = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.split = regex.compile(split["pattern"]["Regex"])

    # A word here is a run without ASCII white space. Neither the normaliser nor the split pattern looks across such white space, so a
    # text's ids are its words' ids one after another.

    def pieces(self, word: bytes) -> list[bytes | int]:
        """Pre-tokens of a word in UTF-8; special tokens as their ids."""
        text = word.decode()
        parts = self.special_split.split(text) if self.special_split and "<|" in text else [text]
        out: list[bytes | int] = []
        for part in parts:
            if part in self.special:
                out.append(self.special[part])
            else:
                # Lower case goes character by character, without the final sigma of a word in context.
                part = unicodedata.normalize("NFC", part).replace("Σ", "σ").lower()
                out += [x.encode() for x in self.split.findall(part)]
        return out

    def ranked(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair of symbols, NO_RANK for those that never merge."""
        key = left.astype(np.int64) * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NO_RANK)

    def merged(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all ``pieces`` one after another and their bounds (length n + 1). Pieces are not empty."""
        size = np.array([len(p) for p in pieces], np.int64)
        raw = np.frombuffer(b"".join(pieces), np.uint8)
        bounds = np.zeros(len(pieces) + 1, np.int64)
        np.cumsum(size, out=bounds[1:])
        symbol = self.plain[raw]
        symbol[bounds[1:] - 1] = self.ending[raw[bounds[1:] - 1]]
        word = np.arange(len(pieces))  # of each active word, its number
        owner = np.repeat(np.arange(len(pieces)), size)  # of each symbol, its active word
        rank = np.full(len(symbol), NO_RANK, np.int32)  # of the pair of this symbol and the next
        inner = np.flatnonzero(owner[1:] == owner[:-1])
        rank[inner] = self.ranked(symbol[inner], symbol[inner + 1])
        done_symbols, done_owner = [], []
        while len(symbol):
            start = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            lowest = np.minimum.reduceat(rank, start)
            over = lowest == NO_RANK
            if over.any():
                each = np.repeat(over, np.diff(np.r_[start, len(symbol)]))
                done_symbols.append(symbol[each])
                done_owner.append(word[owner[each]])
                keep = ~each
                renumber = np.cumsum(~over) - 1
                symbol, rank, owner, word, lowest = symbol[keep], rank[keep], renumber[owner[keep]], word[~over], lowest[~over]
                if not len(symbol):
                    break
            hit = np.flatnonzero(rank == lowest[owner])
            # In a run of overlapping occurrences (aaa) every other one merges, from the left.
            run = np.r_[True, hit[1:] != hit[:-1] + 1]
            place = np.arange(len(hit)) - np.maximum.accumulate(np.where(run, np.arange(len(hit)), 0))
            hit = hit[place % 2 == 0]
            symbol[hit] = self.made[rank[hit]]
            keep = np.ones(len(symbol), bool)
            keep[hit + 1] = False
            # A merged symbol's pair with its successor, and its predecessor's pair with it, are new.
            moved = np.cumsum(keep) - 1
            symbol, owner, rank = symbol[keep], owner[keep], rank[keep]
            new = moved[hit]
            fresh = np.unique(np.r_[new, new[new > 0] - 1])
            last = np.r_[owner[1:] != owner[:-1], True]
            rank[fresh] = NO_RANK
            fresh = fresh[~last[fresh]]
            rank[fresh] = self.ranked(symbol[fresh], symbol[fresh + 1])
        ids, owners = np.concatenate(done_symbols or [np.empty(0, np.int32)]), np.concatenate(done_owner or [np.empty(0, np.int64)])
        order = np.argsort(owners, kind="stable")
        counts = np.bincount(owners, minlength=len(pieces))
        np.cumsum(counts, out=bounds[1:])
        return ids[order], bounds

    def words(self, words: list[bytes]) -> list[bytes]:
        """Ids of each word, as little-endian 32-bit integers."""
        pieces, lookup, plans = [], {}, []
        for w in words:
            plan = []
            for p in self.pieces(w):
                if isinstance(p, bytes):
                    if (k := lookup.get(p)) is None:
                        k = lookup[p] = len(pieces)
                        pieces.append(p)
                    plan.append(k)
                else:
                    plan.append(-1 - p)
            plans.append(plan)
        ids, at = self.merged(pieces)
        raw, at = ids.astype("<u4").tobytes(), (at * 4).tolist()
        one = lambda k: raw[at[k] : at[k + 1]] if k >= 0 else (-1 - k).to_bytes(4, "little")
        return [one(p[0]) if len(p) == 1 else b"".join(map(one, p)) for p in plans]

    def decoded(self, ids: np.ndarray) -> bytes:
        """What the library's decode gives without a decoder: the tokens as they stand in the vocabulary, joined by spaces."""
        return b" ".join(map(self.token.__getitem__, ids.tolist()))


def cased(text: bytes) -> bytes:
    """A-Z to lower case before words are told apart, as the normaliser does it anyway; but special tokens are matched before it."""
    return text if b"<|" in text else text.lower()


@functools.cache
def loaded(path: str) -> Bpe:
    return Bpe(path)


def remembered(path: str) -> WordTable:
    """Kept until the worker serves another operator, so that its tasks don't each learn the same words."""
    return kept((__name__, path), lambda: WordTable(loaded(path).words, "<u4"))


def encoded(docs: DataFrame, path: str | None = None, carry: tuple[str, ...] = ("doc_id",), keep_ids: bool = False) -> DataFrame:
    """docs(text, ...) -> the ``carry`` columns, n_tokens, ids_sha256, decoded_sha256 and, if asked for, ids and decoded.

    Whole texts; a null text counts as empty and has no ids. One row for every row; an empty table gives an empty result; columns that
    are not carried are not read, so their names can't clash; a carried column that bears the name of a result is refused (ValueError).
    """
    if clash := {c.lower() for c in carry} & {"n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded"}:
        raise ValueError(f"carried columns bear names of results: {sorted(clash)}")
    path = path or vocabulary_path()
    picked = docs.select(*carry, docs["text"].alias("__text"))
    schema = [f"`{f.name}` {f.dataType.simpleString()}" for f in picked.schema if f.name != "__text"]
    schema += ["n_tokens long", "ids_sha256 string", "decoded_sha256 string"] + ["ids array<int>", "decoded string"] * keep_ids

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, cache = loaded(path), remembered(path)
        for batch, raw in portions(batches, "__text"):
            n, first, second, ids, texts = [], [], [], [], []
            for own in cache.ids([cased(t) for t in raw]):
                text = bpe.decoded(own)
                n.append(len(own))
                first.append(hashlib.sha256(own.tobytes()).hexdigest())
                second.append(hashlib.sha256(text).hexdigest())
                if keep_ids:
                    ids.append(own.astype(np.int32))
                    texts.append(text.decode())
            names = [x for x in batch.schema.names if x != "__text"]
            out = [batch.column(x) for x in names] + [pa.array(n, pa.int64()), pa.array(first, pa.string()), pa.array(second, pa.string())]
            out += [pa.array(ids, pa.list_(pa.int32())), pa.array(texts, pa.string())] if keep_ids else []
            yield pa.RecordBatch.from_arrays(out, names=names + ["n_tokens", "ids_sha256", "decoded_sha256"] + ["ids", "decoded"] * keep_ids)

    return picked.mapInArrow(run, ", ".join(schema))
