"""BPE encoding and decoding with a pair occurrence index.

The distinct pieces of words of a slice of a partition that earlier slices did
not hold are laid out as one chain of symbols. An index maps each pair's rank to all
its positions; active ranks are applied in ascending order, each to all its
positions at once, and the lists of the pairs that a merge makes or breaks are
updated. Positions that went stale are dropped when their rank's turn comes.
What a word and a piece become is kept for the next slices of the partition, by
their own bytes; more than ``KEPT_WORDS`` of them are forgotten all at once
before a slice, which costs time and changes nothing.

The vocabulary is a tokenizers JSON file of the word-end kind: NFC, lower
case, words split into letters, single digits, other marks and English
contractions, UTF-8 bytes as symbols, ``</w>`` on the last. It is read on the
driver (some megabytes, fixed) and shipped to the workers. A file that
normalises, splits or decodes otherwise is refused. Ranks must rise
along every chain of merges, as training makes them; a file whose ranks do
not is refused.

Defined results: a null text is empty; an empty text has no tokens; white
space gives none; the strings of special tokens in a text become their ids;
repeated rows each get theirs; long texts are encoded whole, a stretch of
words at a time; an empty table
gives an empty result. ``decode`` joins token strings by one space, as a
tokenizer without a decoder does; null ids decode to an empty text.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from array import array
from collections import defaultdict
from collections.abc import Callable, Iterable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.words import flat, steps

SLICE_BYTES = 8 << 20
KEPT_WORDS = 400_000
WORD_END = "</w>"
#: What ``bytes.split`` splits at.
_BLANK = re.compile(rb"[ \t-\r]")
# The steps that a file must state, as this encoder knows no others.
NORMALIZER = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
SPLITTER = [
    {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
    {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
]


def default_vocabulary() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


def _byte_characters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class Vocabulary:
    """Token strings, merge ranks and special tokens of a file."""

    def __init__(self, path: str):
        spec = json.loads(Path(path).read_text(encoding="utf-8"))
        model, ids = spec["model"], spec["model"]["vocab"]
        if model["type"] != "BPE" or model["end_of_word_suffix"] != WORD_END:
            raise ValueError(f"{path} is no BPE vocabulary with word ends")
        if (spec["normalizer"] or {}).get("normalizers") != NORMALIZER or (spec["pre_tokenizer"] or {}).get("pretokenizers") != SPLITTER or spec["decoder"]:
            raise ValueError(f"{path} normalises, splits or decodes in another way")
        if any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "fuse_unk", "byte_fallback", "ignore_merges")):
            raise ValueError(f"{path} merges in another way")
        if any(t[k] for t in spec["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized")) or any(re.search(r"\s", t["content"]) for t in spec["added_tokens"]):
            raise ValueError(f"{path} has added tokens that are more than plain strings")
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = [""] * (1 + max([*ids.values(), *self.special.values()]))
        for t, i in (ids | self.special).items():
            self.tokens[i] = t
        characters = _byte_characters()
        self.inner = np.array([ids[c] for c in characters], np.int32)
        self.final = np.array([ids[c + WORD_END] for c in characters], np.int32)
        self.left, self.right, self.made = (np.array(x, np.int32) for x in zip(*((ids[a], ids[b], ids[a + b]) for a, b in pairs), strict=True))
        first_use: dict[int, int] = {}
        for r, (a, b) in enumerate(zip(self.left.tolist(), self.right.tolist(), strict=True)):
            first_use.setdefault(a, r)
            first_use.setdefault(b, r)
        if any(first_use.get(m, r + 1) <= r for r, m in enumerate(self.made.tolist())):
            raise ValueError(f"{path}: a merge's result is used by an earlier rank")
        keys = (self.left.astype(np.int64) << 32) | self.right
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        self.pieces = r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\p{White_Space}\p{L}\p{N}]+"


class Encoder:
    """Encodes words of one partition. ``pieces`` and ``words`` have what each of ``renders`` makes of their ids: a string, that of a word the pieces' joined."""

    def __init__(self, vocabulary: Vocabulary, *renders: Callable[[list[int]], str | bytes]):
        self.v, self.renders = vocabulary, renders
        self.splitter = regex.compile(vocabulary.pieces)
        self.special = regex.compile("(" + "|".join(map(regex.escape, sorted(vocabulary.special, key=len, reverse=True))) + ")") if vocabulary.special else None
        self.pieces: list[dict[bytes, str | bytes]] = [{} for _ in renders]
        self.words: list[dict[bytes, str | bytes]] = [{} for _ in renders]

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of each pair; -1 for none."""
        key = (a.astype(np.int64) << 32) | b
        at = np.minimum(np.searchsorted(self.v.keys, key), len(self.v.keys) - 1)
        return np.where(self.v.keys[at] == key, self.v.ranks[at], -1)

    def merge(self, symbol: np.ndarray, final: np.ndarray) -> np.ndarray:
        """Applies all merges in place to words laid end to end (``final`` marks last symbols); returns which symbols are left."""
        n = len(symbol)
        alive = np.ones(n, bool)
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        after[final] = -1
        before[np.flatnonzero(final)[:-1] + 1] = -1
        start = np.flatnonzero(after >= 0)
        rank = self.rank(symbol[start], symbol[after[start]])
        start, rank = start[rank >= 0], rank[rank >= 0]
        order = np.argsort(rank, kind="stable")
        start, rank = start[order], rank[order]
        cut = np.flatnonzero(np.r_[True, rank[1:] != rank[:-1]]) if len(rank) else np.empty(0, int)
        places: dict[int, list[np.ndarray]] = {int(rank[c]): [p] for c, p in zip(cut, np.split(start, cut[1:]), strict=True)} if len(rank) else {}
        late: dict[int, list[int]] = defaultdict(list)
        active = list(places)
        heapq.heapify(active)
        waiting = set(active)
        left, right, made = self.v.left, self.v.right, self.v.made
        while active:
            r = heapq.heappop(active)
            waiting.discard(r)
            at = np.array(late.pop(r, []), np.int64)
            if r in places:
                at = np.concatenate([places.pop(r)[0], at])
            a, b = left[r], right[r]
            at = at[alive[at] & (symbol[at] == a)]
            if not len(at):
                continue
            at = np.unique(at)
            following = after[at]
            ok = (following >= 0) & (symbol[following] == b)
            at, following = at[ok], following[ok]
            if a == b and len(at) > 1:
                fresh = np.r_[True, following[:-1] != at[1:]]
                run = np.cumsum(fresh) - 1
                odd = (np.arange(len(at)) - np.flatnonzero(fresh)[run]) % 2 == 1
                at, following = at[~odd], following[~odd]
            if not len(at):
                continue
            symbol[at] = made[r]
            alive[following] = False
            beyond = after[following]
            after[at] = beyond
            more = beyond >= 0
            before[beyond[more]] = at[more]
            prior = before[at]
            has = prior >= 0
            new = np.concatenate([prior[has], at[more]])
            if len(new):
                rank = self.rank(symbol[new], symbol[after[new]])
                good = rank >= 0
                for k, p in zip(rank[good].tolist(), new[good].tolist(), strict=True):
                    late[k].append(p)
                    if k not in waiting:
                        waiting.add(k)
                        heapq.heappush(active, k)
        return alive

    def split(self, word: bytes) -> list[bytes]:
        """The pieces of a word (a run without blanks); a special token is one, after a blank."""
        if word.isalpha():
            return [word.lower()]
        out, text = [], word.decode("utf-8", "replace")
        for part in self.special.split(text) if self.special and self.special.search(text) else (text,):
            if part in self.v.special:
                out.append(f" {part}".encode())
                continue
            if not part.isascii():
                part = unicodedata.normalize("NFC", part)
            lower = "".join(c.lower() for c in part) if "\u03a3" in part else part.lower()
            out += [piece.encode("utf-8") for piece in self.splitter.findall(lower)]
        return out

    def encode(self, pieces: list[bytes]) -> list[list[int]]:
        """The ids of each piece."""
        raw = np.frombuffer(b"".join(pieces), np.uint8)
        end = np.cumsum(np.fromiter(map(len, pieces), np.int64, len(pieces)))
        symbol, final = self.v.inner[raw], np.zeros(len(raw), bool)
        final[end - 1] = True
        symbol[final] = self.v.final[raw[final]]
        alive = self.merge(symbol, final) if len(raw) else np.empty(0, bool)
        left = np.r_[0, np.cumsum(alive)][np.r_[0, end]].tolist()
        ids = symbol[alive].tolist()
        return [[self.v.special[p[1:].decode()]] if p[0] == 32 else ids[a:b] for p, a, b in zip(pieces, left, left[1:], strict=False)]

    def learn(self, texts: Iterable[list[bytes]]) -> list[Callable[[bytes], str | bytes]]:
        """Lookups in ``words``, with all words of the texts. It starts anew once it holds more than ``KEPT_WORDS``."""
        if len(self.words[0]) > KEPT_WORDS:
            self.pieces, self.words = [{} for _ in self.renders], [{} for _ in self.renders]
        new = list(set().union(*texts).difference(self.words[0]))
        split = list(map(self.split, new))
        fresh = list(set().union(*split).difference(self.pieces[0]))
        ids = self.encode(fresh)
        for render, pieces, words in zip(self.renders, self.pieces, self.words, strict=True):
            pieces.update(zip(fresh, map(render, ids), strict=True))
            join = render([]).join
            words.update(zip(new, [pieces[own[0]] if len(own) == 1 else join([pieces[p] for p in own]) for own in split], strict=True))
        return [words.__getitem__ for words in self.words]


def _stretches(text: bytes, size: int) -> Iterator[list[bytes]]:
    """The words of a text, a stretch of about ``size`` bytes at a time; at least one list."""
    at = 0
    while len(text) - at > size:
        blank = _BLANK.search(text, at + size)
        end = blank.start() if blank else len(text)
        yield text[at:end].split()
        at = end
    yield text[at:].split()


def _spoken(batches: Iterable[pa.RecordBatch], encoder: Encoder) -> Iterator[tuple[pa.Array, Iterator[Iterator[list]]]]:
    """Ids of some documents, and for each document, stretch by stretch, what ``encoder`` renders of its words."""

    def stretch(words: list[bytes], lookups: list) -> list:
        return [render([]).join(map(of, words)) for render, of in zip(encoder.renders, lookups, strict=True)]

    for batch in batches:
        for part in steps(batch, "text", SLICE_BYTES):
            raw, ends = flat(part.column("text"))
            raw, ends = raw.tobytes(), ends.tolist()
            if len(raw) > SLICE_BYTES:
                yield part.column("doc_id"), iter([(stretch(words, encoder.learn([words])) for words in _stretches(raw, SLICE_BYTES))])
            else:
                texts = [raw[a:b].split() for a, b in zip(ends, ends[1:], strict=False)]
                lookups = encoder.learn(texts)
                yield part.column("doc_id"), (iter([stretch(words, lookups)]) for words in texts)


def _select(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def encode(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """doc_id, n_tokens and ids (array of int) of every document."""
    vocabulary = Vocabulary(path or default_vocabulary())

    def run(batches):
        for names, texts in _spoken(batches, Encoder(vocabulary, lambda ids: array("i", ids).tobytes())):
            ids = [b"".join(x for (x,) in stretches) for stretches in texts]
            n = np.array([len(x) // 4 for x in ids], np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(n)], pa.int32()), pa.array(np.frombuffer(b"".join(ids), np.int32)))
            yield pa.RecordBatch.from_arrays([names, pa.array(n), lists], names=["doc_id", "n_tokens", "ids"])

    return _select(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_tokens long, ids array<int>")


def decode(encoded: DataFrame, *, id_col: str = "doc_id", ids_col: str = "ids", path: str | None = None) -> DataFrame:
    """doc_id and the decoded text of every row of ids."""
    tokens = Vocabulary(path or default_vocabulary()).tokens

    def run(batches):
        for batch in batches:
            texts = [" ".join([tokens[i] for i in ids or () if i is not None and 0 <= i < len(tokens)]) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).cast("array<int>").alias("ids")).mapInArrow(run, "doc_id long, text string")


def digests(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, and SHA-256 of the ids in decimal and of the text they decode to."""
    vocabulary = Vocabulary(path or default_vocabulary())

    def run(batches):
        tokens, decimal = [f" {t}" for t in vocabulary.tokens], [f" {i}" for i in range(len(vocabulary.tokens))]
        encoder = Encoder(vocabulary, lambda ids: "".join([decimal[i] for i in ids]), lambda ids: "".join([tokens[i] for i in ids]))
        for names, texts in _spoken(batches, encoder):
            rows = []
            for stretches in texts:
                n, digests = 0, (hashlib.sha256(), hashlib.sha256())
                for said in stretches:
                    if said[0]:
                        for digest, x in zip(digests, said, strict=True):
                            digest.update((x if n else x[1:]).encode("utf-8"))
                        n += said[0].count(" ")
                rows.append((n, *(d.hexdigest() for d in digests)))
            yield pa.RecordBatch.from_arrays([names, *map(pa.array, zip(*rows, strict=True))], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return _select(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
