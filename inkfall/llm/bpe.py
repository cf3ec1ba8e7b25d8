"""BPE encoding and decoding with content-defined chunk reuse.

A rolling hash over the code points cuts each text where its value has certain low bits, so equal passages
are cut alike wherever they stand. Of a chunk, the part between its first and last blank, its core, has
an encoding of its own, because no token and no normalisation reaches over a blank; a core is encoded once
and then reused by every document that a worker meets with it. What lies about a cut is re-encoded over the
join, and a join grows by whole chunks until it has a blank on both sides: from there on the encodings agree
exactly with that of the whole text.
"""

from __future__ import annotations

import hashlib
import os
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from inkfall.llm.common import pick, ship, table

#: Code points a rolling hash covers (a power of two), and the mean length of a chunk.
WINDOW, MEAN = 16, 512
#: Characters kept by a worker's memory of cores, which starts anew beyond that, and of words, of which the older half is forgotten.
CORE_CHARS, WORD_CHARS = 2_000_000, 2_000_000
#: Characters of the documents that are encoded together.
BATCH_CHARS = 1_000_000
#: Unknown words that are encoded as one text, a special token between each two.
TOGETHER = 64
_B = np.uint32(0x9E3779B1)


def cuts(text: str, mean: int = MEAN, window: int = WINDOW) -> list[int]:
    """Where the text is cut: after each window whose hash is 0 modulo the mean (a power of two)."""
    if len(text) <= window:
        return []
    h = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4") * np.uint32(0x85EBCA6B)
    b, reach = _B, 1
    with np.errstate(over="ignore"):
        while reach < window:  # doubles the reach of each place's hash
            h = h[reach:] + b * h[:-reach]
            b, reach = b * b, reach * 2
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x2C1B3C6D)
    return (np.flatnonzero((h >> np.uint32(9)) % np.uint32(mean) == 0) + window).tolist()


def pieces(text: str, mean: int = MEAN) -> list[tuple[bool, str]]:
    """(is a core, text) in order; they meet at blanks only. Joined, they are the text with blanks as spaces."""
    text = text.replace("\t", " ").replace("\n", " ").replace("\r", " ")
    out, join, at = [], 0, 0  # the join that is open starts at `join`
    for cut in [*cuts(text, mean), len(text)]:
        first = text.find(" ", at, cut)
        if first >= 0:  # otherwise the join grows over the whole chunk
            last = text.rfind(" ", at, cut)
            out.append((False, text[join:first]))
            out.append((True, text[first:last]))
            join = last
        at = cut
    out.append((False, text[join:]))
    return out


class Codec:
    """A tokenizer with its memory of words and cores: each is [ids as little-endian u32, decoded text]."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        os.environ.setdefault("RAYON_NUM_THREADS", "1")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        if self.tokenizer.decoder is not None:
            raise ValueError("only tokenizers whose decoding joins tokens by spaces are supported")
        self.names = [self.tokenizer.id_to_token(i) for i in range(self.tokenizer.get_vocab_size())]
        special = {t.content: i for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        self.special = re.compile("|".join(map(re.escape, special)))
        self.between, self.between_id = min(special.items(), key=lambda x: x[1])
        self.ids: dict[str, bytes] = {"": b""}
        self.decoded: dict[str, str] = {"": ""}
        self.old_ids: dict[str, bytes] = {}
        self.old_decoded: dict[str, str] = {}
        self.cores: dict[str, tuple[bytes, str]] = {}
        self.core_chars = 0
        self.word_chars = 0
        self.reused = self.met = 0

    def _learn(self, words: list[str]) -> None:
        """A special token stands between words that are encoded together, as nothing reaches over it."""
        odd = list(filter(self.special.search, words))
        plain = list(set(words).difference(odd)) if odd else words
        groups = [plain[i : i + TOGETHER] for i in range(0, len(plain), TOGETHER)]
        for group, e in zip(groups, self.tokenizer.encode_batch_fast([self.between.join(g) for g in groups], add_special_tokens=False), strict=True):
            ids = np.array(e.ids, dtype="<u4")
            ends = [*np.flatnonzero(ids == self.between_id).tolist(), len(ids)]
            at = 0
            for w, end in zip(group, ends, strict=True):
                self._keep(w, ids[at:end])
                at = end + 1
        for w, e in zip(odd, self.tokenizer.encode_batch_fast(odd, add_special_tokens=False), strict=True):
            self._keep(w, np.array(e.ids, dtype="<u4"))

    def _keep(self, word: str, ids) -> None:
        self.ids[word] = ids.tobytes()
        self.decoded[word] = " ".join([self.names[i] for i in ids.tolist()])
        self.word_chars += len(word)

    def _joined(self, text: str) -> tuple[bytes, str]:
        words = text.split(" ")
        return b"".join(map(self.ids.__getitem__, words)), " ".join(filter(None, map(self.decoded.__getitem__, words)))

    def encode(self, texts: list[str]) -> list[tuple[bytes, str]]:
        """(ids, decoded text) of each text."""
        if 2 * self.word_chars > WORD_CHARS:  # what the next texts hold comes back from the older half
            self.old_ids, self.old_decoded = self.ids, self.decoded
            self.ids, self.decoded, self.word_chars = {"": b""}, {"": ""}, 0
        if self.core_chars > CORE_CHARS:
            self.cores, self.core_chars = {}, 0
        parts = [pieces(t) for t in texts]
        new_cores = {p for ps in parts for core, p in ps if core and p not in self.cores}
        joins = {p for ps in parts for core, p in ps if not core}
        self.met += sum(len(ps) // 2 for ps in parts)
        self.reused += sum(len(ps) // 2 for ps in parts) - len(new_cores)
        need = set()
        for p in new_cores:
            need.update(p.split(" "))
        for p in joins:
            need.update(p.split(" "))
        need -= self.ids.keys()
        known = need & self.old_ids.keys()
        self.ids.update((w, self.old_ids[w]) for w in known)
        self.decoded.update((w, self.old_decoded[w]) for w in known)
        self.word_chars += sum(map(len, known))
        self._learn(list(need - known))
        for p in new_cores:
            self.cores[p] = self._joined(p)
            self.core_chars += len(p)
        again = {p: self._joined(p) for p in joins}
        out = []
        for ps in parts:
            got = [self.cores[p] if core else again[p] for core, p in ps]
            out.append((b"".join([g[0] for g in got]), " ".join([g[1] for g in got if g[1]])))
        return out


_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """The worker's codec of a vocabulary file."""
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def _encoded(path: str, digests: bool, decoded: bool | str):
    digest = lambda d: hashlib.sha256(d.encode()).hexdigest()
    told = {True: lambda d: d, False: lambda d: None, "digest": digest}["digest" if digests else decoded]

    def run(batches):
        c = codec(path)
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            lo = 0
            while lo < len(texts):
                some, n = [], 0
                while lo + len(some) < len(texts) and n < BATCH_CHARS:
                    some.append(texts[lo + len(some)].as_py() or "")
                    n += len(some[-1])
                got = c.encode(some)
                key = ids.slice(lo, len(some))
                lo += len(some)
                count = pa.array([len(i) // 4 for i, _ in got], pa.int64())
                if digests:
                    cols = [key, count, pa.array([hashlib.sha256(i).hexdigest() for i, _ in got], pa.string()), pa.array([told(d) for _, d in got], pa.string())]
                else:
                    flat = pa.array(np.frombuffer(b"".join([i for i, _ in got]), dtype="<u4").astype(np.int32))
                    ends = np.cumsum([0, *[len(i) // 4 for i, _ in got]]).astype(np.int32)
                    cols = [key, count, pa.ListArray.from_arrays(pa.array(ends), flat), pa.array([told(d) for _, d in got], pa.string())]
                yield pa.RecordBatch.from_arrays(cols, names=["key", "n_tokens", "ids", "decoded"])

    return run


def encode_documents(docs: DataFrame, path: str, digests: bool = False, key: str = "doc_id", decoded: bool | str = True) -> DataFrame:
    """key, n_tokens, ids (array of int), decoded of every document; with digests the SHA-256 of both instead, with decoded="digest" of the latter.

    Encodes as the library does without special tokens around the text, truncation or padding; special
    tokens that stand in a text count as such. Null and empty texts have no tokens and decode to the empty
    text. Rows are encoded each, repeated ones too, and an empty table gives an empty result.
    """
    ship(docs.sparkSession)
    rows = pick(docs, key, "text")
    kind = dict(rows.dtypes)[key]
    out = f"key {kind}, n_tokens long, ids {'string' if digests else 'array<int>'}, decoded string"
    got = rows.mapInArrow(_encoded(path, digests, decoded), out).withColumnRenamed("key", key)
    return got if decoded or digests else got.drop("decoded")


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op9_bpe(spark, sf_dir):
    got = encode_documents(table(spark, sf_dir, "documents"), vocabulary(), digests=True)
    return got.withColumnsRenamed({"ids": "ids_sha256", "decoded": "decoded_sha256"})


QUERIES = {"op9_bpe": op9_bpe}
ORACLES: dict[str, str] = {}
