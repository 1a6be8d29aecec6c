"""BPE encoding and decoding as streaming transducers with bounded lookahead.

The encoder reads the symbols of a word from left to right. For every prefix it keeps the last token of that prefix's
encoding: the only token ``t`` that ends there and may follow the last token of the prefix before ``t``. Whether ``b`` may
follow ``a`` depends on the two tokens alone (``follows``): no merge across their border may come before the merges that use
up its two sides. A token is stable once the prefixes that a later token can still follow (at most the longest
token's length back) all descend from it; ``lookahead`` is the number of symbols after which that holds, computed from
the merge list. Stable tokens are emitted and their prefixes dropped, so a word of any length takes constant memory.

The decoder turns ids into bytes and bytes into text, holding back only the bytes of an unfinished character.

Defined results: null text is empty and has no token; repeated rows keep their rows; an empty table gives an empty
table; further columns are not read. Words repeat, so each worker remembers a bounded number of them.
"""

from __future__ import annotations

import codecs
import hashlib
import itertools
import json
import unicodedata
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame

from .text import prepared

#: Words and runs that a worker remembers at most, and the longest remembered.
REMEMBERED, LONGEST_REMEMBERED = 250_000, 48
#: Places of the table that tells a second occurrence from a first.
SEEN = 1 << 21
#: Signs that end a run of letters and are a word of their own.
SINGLE = frozenset(".,;:!?")
#: Tokens handed to the digests at a time.
BLOCK = 8192
#: Documents whose ids are returned at a time.
ROWS = 256
# White space of the vocabulary's normaliser.
SPACE = regex.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
ODD_SPACE = regex.compile("[\x1c-\x1f]")  # blanks for str.split, not for the normaliser


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, extra = [""] * 256, itertools.count(256)
    for b in range(256):
        out[b] = chr(b) if b in plain else chr(next(extra))
    return out


class Transducer:
    """Encoder of one merge list over symbol strings; ``end`` marks the last symbol of a word."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], end: str):
        self.end, self.vocab = end, vocab
        self.rank: dict[int, int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        self.merged: dict[tuple[int, int], int] = {}
        for r, (a, b) in enumerate(merges):
            pair = vocab[a], vocab[b]
            made = vocab[a + b]
            self.rank[made], self.parts[made], self.merged[pair] = r, pair, r
        closed = {t[: -len(end)]: i for t, i in vocab.items() if t.endswith(end)}
        self.inner = self._by_suffix({t: i for t, i in vocab.items() if not t.endswith(end)})
        self.closing = self._by_suffix(closed)
        self.longest = max(map(len, [*self.inner, *self.closing]))
        self.lookahead = self._lookahead()
        self.allowed: dict[tuple[int, int], bool] = {}
        self.whole: dict[int, bool] = {}

    @staticmethod
    def _by_suffix(tokens: dict[str, int]) -> dict[str, int]:
        """The tokens and, as -1, all suffixes of tokens: a text that is none of them ends no longer token."""
        out = dict.fromkeys((t[k:] for t in tokens for k in range(len(t))), -1)
        out.update(tokens)
        return out

    def _spine(self, token: int, side: int) -> list[int]:
        """The token and its outermost parts on one side (0 left, 1 right), down to one symbol."""
        out = [token]
        while out[-1] in self.parts:
            out.append(self.parts[out[-1]][side])
        return out

    def _lookahead(self) -> int:
        """Symbols to the right that can decide whether a merge takes place.

        A merge (u, v) is prevented from the right only by an earlier merge that takes v or a right part of v; that one
        only by a still earlier one. Ranks fall along such a chain, so one pass in rank order finds the longest.
        """
        length = {i: len(t.removesuffix(self.end)) for t, i in self.vocab.items()}
        reach: dict[int, int] = {}  # by token: symbols read by the longest chain that starts by taking it
        most = 0
        for (a, b), _ in sorted(self.merged.items(), key=lambda x: x[1]):
            need = length[b] + max(reach.get(t, 0) for t in self._spine(b, 1))
            reach[a] = max(reach.get(a, 0), need)
            most = max(most, need)
        return most

    def follows(self, a: int, b: int) -> bool:
        """Whether ``a`` then ``b`` is how their joint text is encoded.

        Goes back through the merges that made the border's two sides, latest first. A merge across the border that
        comes before the side's own next merge (at one rank the left one goes first) would have taken place.
        """
        left, right, left_end, right_end = a, b, len(self.merged), len(self.merged)
        while True:
            crossing = self.merged.get((left, right))
            if crossing is not None and crossing < left_end and crossing <= right_end:
                return False
            made_left, made_right = self.rank.get(left, -1), self.rank.get(right, -1)
            if made_left < 0 and made_right < 0:
                return True
            if made_left > made_right:
                left, left_end = self.parts[left][1], made_left
            else:
                right, right_end = self.parts[right][0], made_right

    def _stands(self, token: int) -> bool:
        """Whether the token's own text is encoded as the token."""
        ok = self.whole.get(token)
        if ok is None:
            ok = self.whole[token] = token not in self.parts or self._formed(token)
        return ok

    def _formed(self, token: int) -> bool:
        a, b = self.parts[token]
        if not (self._stands(a) and self._stands(b)):
            return False
        left, right, left_end, right_end = a, b, self.rank[token] + 1, self.rank[token]
        while True:
            crossing = self.merged.get((left, right))
            if crossing is not None and crossing < left_end and crossing <= right_end and (left, right) != (a, b):
                return False
            made_left, made_right = self.rank.get(left, -1), self.rank.get(right, -1)
            if made_left < 0 and made_right < 0:
                return True
            if made_left > made_right:
                left, left_end = self.parts[left][1], made_left
            else:
                right, right_end = self.parts[right][0], made_right

    def _judge(self, before: int, token: int) -> bool:
        """``allowed`` for a pair that is not remembered; -1 stands for the start of the word."""
        if len(self.allowed) > REMEMBERED:
            self.allowed.clear()
        ok = self.allowed[before, token] = self._stands(token) and (before < 0 or self.follows(before, token))
        return ok

    def short(self, text: str) -> tuple[int, ...]:
        """``stream`` for a word of one piece: nothing can be emitted before its end is seen."""
        allowed, inner, last, begin = self.allowed.get, self.inner, [-1], [0]
        n = len(text)
        for i in range(1, n + 1):
            if i == n:
                inner = self.closing
            j = i - 1
            while True:
                token = inner[text[j:i]]
                if token >= 0:
                    before = last[j]
                    ok = allowed((before, token))
                    if ok or ok is None and self._judge(before, token):
                        last.append(token)
                        begin.append(j)
                        break
                j -= 1
        out = []
        while n:
            out.append(last[n])
            n = begin[n]
        out.reverse()
        return tuple(out)

    def stream(self, pieces: Iterable[str]) -> Iterator[int]:
        """Token ids of one word that arrives in pieces of symbols, each emitted once it is stable."""
        text, base = "", 0  # the symbols from the last emitted border on; base is 1 if a token was emitted before
        last, begin = [-1], [0]  # by prefix of text: its last token and where that begins
        allowed, inner, longest = self.allowed, self.inner, self.longest
        pieces = iter(pieces)
        pending = next(pieces, "")
        while pending:
            coming = next(pieces, "")
            start = len(text)
            text += pending
            n = len(text)
            for i in range(start + 1, n + 1):
                known = self.closing if i == n and not coming else inner
                for j in range(i - 1, -1, -1):
                    token = known.get(text[j:i])
                    if token is None:
                        raise ValueError(f"no encoding of {text[:i]!r}")
                    if token >= 0:
                        before = last[j]
                        ok = allowed.get((before, token))
                        if ok is None:
                            ok = self._judge(before, token)
                        if ok:
                            last.append(token)
                            begin.append(j)
                            break
            live = range(max(0, n - longest + 1), n + 1) if coming else (n,)
            border = self._common(begin, live)
            if border:
                out, k = [], border
                while k:
                    out.append(last[k])
                    k = begin[k]
                yield from reversed(out)
                text = text[border:]
                last = [out[0], *last[border + 1 :]]
                begin = [0, *(b - border for b in begin[border + 1 :])]
            pending = coming

    @staticmethod
    def _common(begin: list[int], live: Iterable[int]) -> int:
        """The last border through which the encodings of all live prefixes go."""
        heads = set(live)
        while len(heads) > 1:
            top = max(heads)
            heads.remove(top)
            heads.add(begin[top])
        return heads.pop()


class Decoder:
    """Ids to text, a block at a time: state is the unfinished character and whether a piece was written."""

    def __init__(self, pieces: list[bytes], joint: bytes = b" "):
        self.pieces, self.joint, self.begun = pieces, joint, False
        self.bytes = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: list[int]) -> str:
        if not ids:
            return ""
        data = self.joint.join(map(self.pieces.__getitem__, ids))
        data, self.begun = (self.joint + data if self.begun else data), True
        return self.bytes.decode(data)

    def close(self) -> str:
        return self.bytes.decode(b"", True)


class Tokenizer:
    """A vocabulary file with its normaliser, word split and added tokens, over ``Transducer`` and ``Decoder``."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.words = regex.compile(split["pattern"]["Regex"])
        self.core = Transducer(model["vocab"], [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]], model["end_of_word_suffix"])
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        names = model["vocab"] | self.added
        self.pieces = [b""] * (max(names.values()) + 1)
        for name, i in names.items():
            self.pieces[i] = name.encode()
        self.digits = [str(i) for i in range(len(self.pieces))]
        self.alphabet = byte_alphabet()
        self.known = Known(self)

    def word(self, word: str) -> tuple[int, ...]:
        found = self.known.get(word)
        if found is None:
            symbols = "".join(map(self.alphabet.__getitem__, word.encode()))
            step = max(self.core.lookahead, 256)  # pieces of a long word
            found = self.core.short(symbols) if len(symbols) <= step else tuple(self.core.stream(symbols[i : i + step] for i in range(0, len(symbols), step)))
            self.known.keep(word, found)
        return found

    def blocks(self, text: str) -> Iterator[list[int]]:
        """Ids of a whole text in blocks of bounded length."""
        parts = self.special.split(text) if self.special and any(s in text for s in self.added) else [text]
        for part in parts:
            if part in self.added:
                yield [self.added[part]]
                continue
            part = unicodedata.normalize("NFC", part)
            chunks = [c for c in SPACE.split(part) if c] if ODD_SPACE.search(part) else part.split()
            for i in range(0, len(chunks), BLOCK):
                yield list(itertools.chain.from_iterable(map(self.known.__getitem__, chunks[i : i + BLOCK])))
                self.known.trim()

    def encode(self, text: str) -> list[int]:
        return list(itertools.chain.from_iterable(self.blocks(text)))

    def decoder(self) -> Decoder:
        return Decoder(self.pieces)


class Known(dict):
    """Ids of words and of runs without white space that came twice or more; forgets all of them when there are too many."""

    def __init__(self, owner: Tokenizer):
        super().__init__()
        self.owner = owner
        self.once = bytearray(SEEN)

    def keep(self, run: str, ids: tuple[int, ...]) -> None:
        if len(run) <= LONGEST_REMEMBERED:
            place = hash(run) % SEEN
            if self.once[place]:
                self[run] = ids
            else:
                self.once[place] = 1

    def __missing__(self, run: str) -> tuple[int, ...]:
        lowered = run.replace("Σ", "σ").lower()  # letter by letter: no final sigma
        word = self.owner.word
        if lowered.isalpha():
            ids = word(lowered)
            if lowered == run:
                return ids
        elif lowered[-1] in SINGLE and lowered[:-1].isalpha():
            ids = word(lowered[:-1]) + word(lowered[-1])
        else:
            ids = tuple(itertools.chain.from_iterable(map(word, self.owner.words.findall(lowered))))
        self.keep(run, ids)
        return ids

    def trim(self) -> None:
        if len(self) > REMEMBERED:
            self.clear()
            self.once = bytearray(SEEN)


def tokenizer(path: str) -> Tokenizer:
    return prepared(("bpe", path), lambda: Tokenizer(path))


def round_trip(docs: DataFrame, doc_id: Column, text: Column, path: str, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every whole text, and the ids if asked for.

    ``path`` names the vocabulary file on every executor. Without ids a text goes through encoder, digests and decoder in
    blocks.
    """

    def one(text: str, tool: Tokenizer) -> tuple[int, str, str, array]:
        n, ids_hash, text_hash, decode, kept = 0, hashlib.sha256(), hashlib.sha256(), tool.decoder(), array("i")
        for ids in tool.blocks(text):
            if ids:
                ids_hash.update(((" " if n else "") + " ".join(map(tool.digits.__getitem__, ids))).encode())
                text_hash.update(decode.feed(ids).encode())
                n += len(ids)
                if with_ids:
                    kept.extend(ids)
        text_hash.update(decode.close().encode())
        return n, ids_hash.hexdigest(), text_hash.hexdigest(), kept

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = tokenizer(path)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                rows = [one(value.as_py() or "", tool) for value in part.column(1)]
                columns = [part.column(0), *(pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.string(), pa.string())))]
                if with_ids:
                    ends = pa.array(itertools.accumulate((r[0] for r in rows), initial=0), pa.int32())
                    ids = array("i")
                    for r in rows:
                        ids.extend(r[3])
                    columns.append(pa.ListArray.from_arrays(ends, pa.array(np.array(ids, np.int32))))
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"][: len(columns)])

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return docs.select(doc_id.cast("long").alias("doc_id"), text.alias("text")).mapInArrow(run, schema)
