"""BPE encoding and decoding by speculation and verification.

A block of texts is cut into words by class tests over whole arrays. Every distinct word gets a proposal by greedy
longest match; the proposals of all new words are verified together: each adjacent pair of tokens must be compatible,
which means that merging the pair's bytes gives the pair again. A word with compatible neighbours throughout has the
one encoding that merging gives; only words with an incompatible pair are merged exactly. Decoding turns ids back into
bytes and those into text.

Null text counts as empty: no ids, empty decoded text. A special token's string in a text becomes that token. Repeated
rows give repeated results; an empty table gives an empty result; other columns pass through `encode` untouched.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

SPACE, WHITE, LETTER, NUMBER, OTHER = range(5)
#: Distinct words and pairs that a worker keeps between blocks; a full store is emptied, which costs time only.
KEPT_WORDS = 1_500_000
KEPT_PAIRS = 2_000_000


def _byte_alphabet() -> dict[str, int]:
    """Characters by which byte-level vocabularies write bytes: printable ones stand for themselves, the others follow from 256."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


def _classes() -> np.ndarray:
    out = np.full(0x110000, OTHER, dtype=np.uint8)
    for c in range(0x110000):
        kind = unicodedata.category(chr(c))[0]
        if kind == "L":
            out[c] = LETTER
        elif kind == "N":
            out[c] = NUMBER
    out[[*range(9, 14), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = WHITE
    out[32] = SPACE
    return out


class Bpe:
    """A byte-level BPE vocabulary of the tokenizers library's JSON form."""

    def __init__(self, definition: str):
        d = json.loads(definition)
        alphabet = _byte_alphabet()
        as_bytes = lambda s: bytes(alphabet[c] for c in s)
        vocab = d["model"]["vocab"]
        self.ids = {as_bytes(t): i for t, i in vocab.items()}
        merges = [m.split(" ") if isinstance(m, str) else m for m in d["model"]["merges"]]
        self.merges = {}
        for rank, (a, b) in enumerate(merges):
            self.merges.setdefault((self.ids[as_bytes(a)], self.ids[as_bytes(b)]), (rank, self.ids[as_bytes(a + b)]))
        self.special = {t["content"].encode(): t["id"] for t in d["added_tokens"]}
        size = 1 + max([*self.ids.values(), *self.special.values()])
        self.pieces = [b""] * size
        for t, i in [*self.ids.items(), *self.special.items()]:
            self.pieces[i] = t
        self.lengths = np.array([len(p) for p in self.pieces], dtype=np.int64)
        self.piece_start = np.concatenate([[0], np.cumsum(self.lengths)])
        self.pool = np.frombuffer(b"".join(self.pieces), dtype=np.uint8)
        self.classes = _classes()
        by_start: dict[bytes, set[int]] = {}
        for t in self.ids:
            if len(t) >= 3:
                by_start.setdefault(t[:3], set()).add(len(t))
        #: lengths of the tokens of 3 bytes or more with the same 3 first bytes, longest first
        self.lengths_of = {k: tuple(sorted(v, reverse=True)) for k, v in by_start.items()}
        self.byte_ids = [self.ids[bytes([b])] for b in range(256)]
        self.whole: dict[int, bool] = {}
        self._forget_words()
        self.pair_key = np.zeros(0, dtype=np.int64)
        self.pair_ok = np.zeros(0, dtype=bool)

    def _forget_words(self) -> None:
        self.word_key = np.zeros(0, dtype=np.uint64)
        self.word_start = np.zeros(0, dtype=np.int64)
        self.word_count = np.zeros(0, dtype=np.int64)
        self.word_ids = np.zeros(0, dtype=np.uint32)
        self.word_bytes = np.zeros(0, dtype=np.uint8)
        self.word_at = np.zeros(0, dtype=np.int64)
        self.word_size = np.zeros(0, dtype=np.int64)

    def merged(self, word: bytes) -> list[int]:
        """Exact merging: the leftmost of the pairs of lowest rank first, kept in a heap over a linked list."""
        ids = [self.byte_ids[b] for b in word]
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(m[0], i, ids[i], ids[i + 1], m[1]) for i in range(n - 1) if (m := self.merges.get((ids[i], ids[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, a, b, new = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = new, -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if m := self.merges.get((new, ids[k])):
                    heapq.heappush(heap, (m[0], i, new, ids[k], m[1]))
            if (h := before[i]) >= 0 and (m := self.merges.get((ids[h], new))):
                heapq.heappush(heap, (m[0], h, ids[h], new, m[1]))
        return [i for i in ids if i >= 0]

    def _proposal(self, word: bytes) -> list[int]:
        ids, lengths_of, out, p, n = self.ids, self.lengths_of, [], 0, len(word)
        while p < n:
            for k in lengths_of.get(word[p : p + 3], ()):
                if p + k <= n and (t := ids.get(word[p : p + k])) is not None:
                    break
            else:
                k = 2
                if p + 2 > n or (t := ids.get(word[p : p + 2])) is None:
                    k, t = 1, self.byte_ids[word[p]]
            out.append(t)
            p += k
        return out

    def _compatible(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """For arrays of neighbours: does merging their joint bytes give the two again?"""
        key = left.astype(np.int64) << 20 | right.astype(np.int64)
        new = np.unique(key)
        at = np.searchsorted(self.pair_key, new)
        known = np.zeros(len(new), dtype=bool)
        inside = at < len(self.pair_key)
        known[inside] = self.pair_key[at[inside]] == new[inside]
        new = new[~known]
        if len(new):
            if len(self.pair_key) > KEPT_PAIRS:
                self.pair_key, self.pair_ok = self.pair_key[:0], self.pair_ok[:0]
                new = np.unique(key)
            pairs = [(k >> 20, k & 0xFFFFF) for k in new.tolist()]
            ok = np.array([self.merged(self.pieces[a] + self.pieces[b]) == [a, b] for a, b in pairs], dtype=bool)
            keys, oks = np.concatenate([self.pair_key, new]), np.concatenate([self.pair_ok, ok])
            order = np.argsort(keys, kind="stable")
            self.pair_key, self.pair_ok = keys[order], oks[order]
        return self.pair_ok[np.searchsorted(self.pair_key, key)]

    def _is_whole(self, token: int) -> bool:
        if (x := self.whole.get(token)) is None:
            x = self.whole[token] = self.merged(self.pieces[token]) == [token]
        return x

    def _learn(self, keys: np.ndarray, words: list[bytes]) -> None:
        proposals = [self._proposal(w) for w in words]
        counts = np.array([len(p) for p in proposals], dtype=np.int64)
        flat = np.array([t for p in proposals for t in p], dtype=np.uint32)
        word_of = np.repeat(np.arange(len(words)), counts)
        good = np.ones(len(words), dtype=bool)
        if len(flat) > 1:
            inner = np.flatnonzero(word_of[1:] == word_of[:-1])
            good[word_of[inner[~self._compatible(flat[inner], flat[inner + 1])]]] = False
        whole = {int(t): self._is_whole(int(t)) for t in np.unique(flat)}
        if not all(whole.values()):
            good[word_of[np.isin(flat, [t for t, ok in whole.items() if not ok])]] = False
        for i in np.flatnonzero(~good).tolist():
            proposals[i] = self.merged(words[i])
        counts = np.array([len(p) for p in proposals], dtype=np.int64)
        flat = np.array([t for p in proposals for t in p], dtype=np.uint32)
        start = len(self.word_ids) + np.cumsum(counts) - counts
        self.word_ids = np.concatenate([self.word_ids, flat])
        all_keys = np.concatenate([self.word_key, keys])
        order = np.argsort(all_keys, kind="stable")
        self.word_key = all_keys[order]
        self.word_start = np.concatenate([self.word_start, start])[order]
        self.word_count = np.concatenate([self.word_count, counts])[order]
        sizes = np.array([len(w) for w in words], dtype=np.int64)
        at = len(self.word_bytes) + np.cumsum(sizes) - sizes
        self.word_bytes = np.concatenate([self.word_bytes, np.frombuffer(b"".join(words), dtype=np.uint8)])
        self.word_at = np.concatenate([self.word_at, at])[order]
        self.word_size = np.concatenate([self.word_size, sizes])[order]

    def _misread(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Words of a block whose bytes differ from those of the kept word that their hash points to."""
        size = ends - starts
        bad = self.word_size[word] != size
        size = np.where(bad, 0, size)
        differ = data[common.ragged(starts, size)] != self.word_bytes[common.ragged(self.word_at[word], size)]
        if differ.any():
            bad[np.repeat(np.arange(len(size)), size)[differ]] = True
        return np.flatnonzero(bad)

    def _word_starts(self, data: np.ndarray, cuts: np.ndarray) -> np.ndarray:
        """Byte positions at which words begin. cuts: positions that no word crosses, the block's begin and end among them."""
        lead = (data & 0xC0) != 0x80
        at = np.flatnonzero(lead)
        first = data[at]
        code = first.astype(np.int32)
        far = np.flatnonzero(first >= 0xC0)
        if len(far):
            p, f = at[far], first[far].astype(np.int32)
            nxt = lambda k: data[np.minimum(p + k, len(data) - 1)].astype(np.int32) & 0x3F
            code[far] = np.where(f < 0xE0, (f & 0x1F) << 6 | nxt(1), np.where(f < 0xF0, (f & 0x0F) << 12 | nxt(1) << 6 | nxt(2), (f & 0x07) << 18 | nxt(1) << 12 | nxt(2) << 6 | nxt(3)))
        kind = self.classes[code]
        n = len(at)
        seg = np.zeros(n + 1, dtype=bool)  # a cut before this character
        seg[np.searchsorted(at, cuts)] = True
        white = kind <= WHITE
        family = np.where(white, WHITE, kind)
        start = np.ones(n, dtype=bool)
        start[1:] = family[1:] != family[:-1]
        start |= seg[:n]
        same = ~seg[1:n]  # neighbours i, i + 1 in one segment
        # the last white character before a word begins a new word; a space joins the word after it
        last = white[:-1] & ~white[1:] & same
        start[:-1] |= last
        start[1:][last & (kind[:-1] == SPACE)] = False
        # contractions, where the apostrophe itself begins a word
        quote = np.flatnonzero(code == 39)
        if len(quote):
            prev = np.maximum(quote - 1, 0)
            free = seg[quote] | ((kind[prev] != OTHER) & (kind[prev] != SPACE))
            quote = quote[free & (quote + 1 < n)]
            quote = quote[~seg[quote + 1]]
            c1 = code[quote + 1]
            c2 = np.where((quote + 2 < n) & ~seg[np.minimum(quote + 2, n)], code[np.minimum(quote + 2, n - 1)], 0)
            one = np.isin(c1, [115, 116, 109, 100])  # s t m d
            two = ((c1 == 114) & (c2 == 101)) | ((c1 == 118) & (c2 == 101)) | ((c1 == 108) & (c2 == 108))  # re ve ll
            for hit, width in ((quote[one], 2), (quote[two], 3)):
                start[hit + 1] = False
                ends = hit + width
                inner = ends[(ends < n)]
                # white runs after a contraction keep their own starts; a space before a word was joined to it already
                letters = inner[~white[inner]]
                start[letters] = True
        return at[start]

    def encode_block(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all rows end to end, number of ids of each row)."""
        rows = len(off) - 1
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(rows, np.int64)
        cuts = [off]
        marks: list[tuple[int, int, int]] = []
        raw = data.tobytes()
        for text, token in self.special.items():
            for m in re.finditer(re.escape(text), raw):
                if np.searchsorted(off, m.start(), side="right") == np.searchsorted(off, m.end() - 1, side="right"):
                    marks.append((m.start(), m.end(), token))
        if marks:
            cuts += [np.array([x for m in marks for x in m[:2]])]
        starts = self._word_starts(data, np.unique(np.concatenate(cuts)))
        if marks:
            drop = np.zeros(len(data) + 1, dtype=bool)
            for a, b, _ in marks:
                drop[a + 1 : b] = True
            starts = starts[~drop[starts]]
        ends = np.append(starts[1:], len(data))
        keys = common.range_hashes(data, starts, ends)
        uniq, first, inv = np.unique(keys, return_index=True, return_inverse=True)
        if len(self.word_key) > KEPT_WORDS:
            self._forget_words()
        at = np.searchsorted(self.word_key, uniq)
        known = np.zeros(len(uniq), dtype=bool)
        inside = at < len(self.word_key)
        known[inside] = self.word_key[at[inside]] == uniq[inside]
        if not known.all():
            new = np.flatnonzero(~known)
            self._learn(uniq[new], [raw[a:b] for a, b in zip(starts[first[new]].tolist(), ends[first[new]].tolist())])
            at = np.searchsorted(self.word_key, uniq)
        word = at[inv]
        count, begin = self.word_count[word], self.word_start[word]
        # special tokens, and words that share another word's hash, have ids of their own
        own = {i: self.merged(raw[starts[i] : ends[i]]) for i in self._misread(data, starts, ends, word).tolist()}
        if marks:
            token_at = {a: t for a, _, t in marks}
            own |= {i: [token_at[int(starts[i])]] for i in np.flatnonzero(np.isin(starts, list(token_at))).tolist()}
        ids_pool = self.word_ids
        if own:
            which = np.array(list(own))
            count[which] = [len(x) for x in own.values()]
            begin[which] = len(ids_pool) + np.cumsum(count[which]) - count[which]
            ids_pool = np.concatenate([ids_pool, np.array([t for x in own.values() for t in x], dtype=np.uint32)])
        ids = ids_pool[common.ragged(begin, count)]
        sums = np.concatenate([[0], np.cumsum(count)])
        return ids, np.diff(sums[np.searchsorted(starts, off)])

    def decode_block(self, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes of all rows end to end, offsets of the rows)."""
        size = self.lengths[ids]
        out = self.pool[common.ragged(self.piece_start[ids], size)]
        sums = np.concatenate([[0], np.cumsum(size)])
        return out, sums[np.concatenate([[0], np.cumsum(counts)])]


_loaded: dict[str, Bpe] = {}


def _vocabulary(definition: str) -> Bpe:
    key = hashlib.sha256(definition.encode()).hexdigest()
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = Bpe(definition)
    return _loaded[key]


def _decoded(raw: bytes) -> str:
    return raw.decode("utf-8", "replace")


def encode(docs: DataFrame, vocabulary_path: str, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), with_ids: bool = True) -> DataFrame:
    """The columns `keep`, then n_tokens, ids_sha256, decoded_sha256 and with `with_ids` the ids as array<int>.

    vocabulary_path is a local file of the driver; its content, whose size is fixed, goes to the tasks by broadcast."""
    spark = docs.sparkSession
    with open(vocabulary_path, encoding="utf-8") as f:
        definition = spark.sparkContext.broadcast(f.read())
    fields, text_name = [docs.schema[c] for c in keep], common.free_name(docs, "text")
    schema = T.StructType(fields + [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())] + ([T.StructField("ids", T.ArrayType(T.IntegerType()))] if with_ids else []))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _vocabulary(definition.value)
        for batch in batches:
            for lo, hi, data, off in common.text_blocks(batch, text_name):
                ids, counts = bpe.encode_block(data, off)
                out, out_off = bpe.decode_block(ids, counts)
                id_off = np.concatenate([[0], np.cumsum(counts)])
                little, text = ids.astype("<u4").tobytes(), out.tobytes()
                sha = [hashlib.sha256(little[4 * a : 4 * b]).hexdigest() for a, b in zip(id_off[:-1].tolist(), id_off[1:].tolist())]
                dec = [hashlib.sha256(_decoded(text[a:b]).encode()).hexdigest() for a, b in zip(out_off[:-1].tolist(), out_off[1:].tolist())]
                cols = [batch.column(i).slice(lo, hi - lo) for i in range(len(keep))] + [pa.array(counts, pa.int64()), pa.array(sha, pa.string()), pa.array(dec, pa.string())]
                if with_ids:
                    cols.append(pa.ListArray.from_arrays(pa.array(id_off, pa.int32()), pa.array(ids.astype(np.int32), pa.int32())))
                yield pa.RecordBatch.from_arrays(cols, names=schema.names)

    return common.map_batches(docs.select(*keep, F.col(text_col).alias(text_name)), run, schema)


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(common.read_table(spark, sf_dir, "documents"), default_vocabulary(), with_ids=False)
