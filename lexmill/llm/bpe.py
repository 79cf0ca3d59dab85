"""BPE with word ends: encoding by a depth-first walk over the trie of distinct words, and decoding.

The encoding of a prefix is that of a shorter prefix and one last token, so each node of the trie keeps only its last token.
The last token of a node is the one, of those that end there, that BPE would not have built otherwise together with the last
token of the prefix before it. Words that share a prefix share its nodes. The word's last symbol carries the end mark and is a
leaf of its own. Walking the sorted words with a stack visits the trie depth first, so only the path is held.

Null text is empty: no ids. Texts of any length are read whole; words of any length take time in proportion to it. Rows that
repeat give equal rows; an empty table gives none. Extra columns are not read.
"""

from __future__ import annotations

import functools
import hashlib
import json
import os.path
import re
import unicodedata
from collections.abc import Iterable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from tokenizers import Tokenizer

from .common import documents
from .tokens import byte_alphabet, tokenizer_path

WORD_BPE = "word_bpe_49k.json"
#: A worker forgets its words, and its pairs of tokens, beyond this number, and its words beyond this number of characters.
WORDS, CHARACTERS = 400_000, 1 << 25


class WordBpe:
    """The tokenizer of a tokenizer.json: NFC, white space collapsed, lower case, split, byte level, BPE with an end mark."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            parts = json.load(file)
        model = parts["model"]
        split = next(p for p in parts["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.words = regex.compile(split["pattern"]["Regex"])
        self.end = model["end_of_word_suffix"]
        self.ids: dict[str, int] = model["vocab"]
        # Characters that came after Unicode 3.2 may be letters in one library and unassigned in another: such texts are split by tokenizers.
        self.later = _later_characters()
        self.library = Tokenizer.from_file(path)
        self.special = {t["content"]: t["id"] for t in parts["added_tokens"]}
        self.breaks = re.compile("|".join(map(re.escape, self.special)) or r"(?!)")
        self.byte_of = byte_alphabet()
        self.char_of = {b: c for c, b in self.byte_of.items()}
        self.tokens = {i: t for t, i in self.ids.items()} | {i: t for t, i in self.special.items()}
        # made[t]: when BPE builds t and from what; together[a, b]: when it joins a and b.
        self.made: dict[str, tuple[int, str, str]] = {}
        self.together: dict[tuple[str, str], int] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.together[a, b] = rank
            self.made.setdefault(a + b, (rank, a, b))
        #: Of each token that BPE builds if its symbols come alone: how many they are.
        self.sizes = {t: len(p) for t in self.made if self._plain(p := self._symbols(t)) == [t]}
        self.longest = max(self.sizes.values(), default=1)
        self.safe: dict[tuple[str, str], bool] = {}
        self.known: dict[str | int, tuple[int, str, str]] = {}
        self.size = 0

    def _symbols(self, token: str) -> tuple[str, ...]:
        """The initial symbols of a token: characters, of which the last may carry the end mark."""
        if token in self.made:
            _, a, b = self.made[token]
            return self._symbols(a) + self._symbols(b)
        return (token,)

    def _plain(self, symbols: Iterable[str]) -> list[str]:
        """BPE by its definition: the pair of the lowest rank first, the leftmost of equals."""
        out = list(symbols)
        while True:
            rank, at = min(((self.together.get((a, b), 1 << 60), k) for k, (a, b) in enumerate(zip(out, out[1:]))), default=(1 << 60, 0))
            if rank == 1 << 60:
                return out
            out[at : at + 2] = [out[at] + out[at + 1]]

    def _fits(self, left: str, right: str) -> bool:
        """Whether BPE leaves left and right as they are, side by side.

        Both are taken apart again, latest merge first: at no time may the symbols that then meet at the border have been
        next to merge. At equal ranks the pair further left goes first.
        """
        a, b, limit, ok = left, right, (1 << 60, 0), True
        while True:
            meet = self.together.get((a, b))
            if meet is not None and (meet, 1) < limit:
                ok = False
                break
            when_a = self.made[a][0] if a in self.made else -1
            when_b = self.made[b][0] if b in self.made else -1
            if when_a < 0 and when_b < 0:
                break
            # Undo the later merge; one in b at the same rank comes after one in a.
            if (when_a, 0) > (when_b, 2):
                limit, a = (when_a, 0), self.made[a][2]
            else:
                limit, b = (when_b, 2), self.made[b][1]
        if len(self.safe) > WORDS:
            self.safe.clear()
        self.safe[left, right] = ok
        return ok

    def _spelled(self, word: str) -> str:
        """A word's bytes as the file writes them; visible ASCII characters stand for themselves."""
        if word.isascii() and word.isprintable() and " " not in word:
            return word
        return "".join([self.char_of[b] for b in word.encode()])

    def encode_words(self, words: Iterable[str]) -> dict[str, list[int]]:
        """Ids of distinct words, by one walk over their trie."""
        found: dict[str, list[int]] = {}
        above = ""
        tokens: list[str] = []  # of each prefix on the path, the last token of its encoding
        begins: list[int] = []  # and the depth where that token begins
        stands, safe, fits, longest, end = self.sizes, self.safe, self._fits, self.longest, self.end
        for word, text in sorted((self._spelled(w), w) for w in words):
            n = len(word)
            shared = min(n - 1, len(above)) if above[: n - 1] == word[: len(above)][: n - 1] else len(os.path.commonprefix((above, word[:-1])))
            del tokens[shared:], begins[shared:]
            # Of the tokens that end at a depth the longest come first; the one that fits the encoding before it is the only one that does.
            for depth in range(shared + 1, n):
                for begin in range(depth - longest if depth > longest else 0, depth):
                    token = word[begin:depth]
                    if token in stands and (not begin or (ok := safe.get((tokens[begin - 1], token))) or ok is None and fits(tokens[begin - 1], token)):
                        break
                tokens.append(token)
                begins.append(begin)
            for begin in range(n - longest if n > longest else 0, n):
                token = word[begin:] + end
                if token in stands and (not begin or (ok := safe.get((tokens[begin - 1], token))) or ok is None and fits(tokens[begin - 1], token)):
                    break
            tokens.append(token)
            begins.append(begin)
            above = word[:-1]
            ids, at = [], n
            while at:
                ids.append(self.ids[tokens[at - 1]])
                at = begins[at - 1]
            del tokens[n - 1 :], begins[n - 1 :]  # the leaf with the end mark
            found[text] = ids[::-1]
        return found

    def pieces(self, text: str) -> Iterator[str | int]:
        """Words in order, and the ids of special tokens that the text spells out."""
        at = 0
        for hit in self.breaks.finditer(text):
            yield from self._split(text[at : hit.start()])
            yield self.special[hit.group()]
            at = hit.end()
        yield from self._split(text[at:])

    def _split(self, text: str) -> list[str]:
        if not text.isascii():
            if self.later.search(text):
                pieces = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))
                return [bytes(self.byte_of[c] for c in piece).decode() for piece, _ in pieces]
            text = unicodedata.normalize("NFC", text)
        return self.words.findall(_lower(text))

    def learn(self, texts: Iterable[list[str | int]]) -> None:
        """Encode the words of texts that are not known yet."""
        new = {w for pieces in texts for w in pieces if w not in self.known}
        if len(self.known) + len(new) > WORDS or self.size > CHARACTERS:
            self.known.clear()
            self.size = 0
            new = {w for pieces in texts for w in pieces}
        for special in [w for w in new if isinstance(w, int)]:
            self.known[special] = (1, str(special), self.decode([special]))
            new.discard(special)
        for word, ids in self.encode_words(new).items():
            self.known[word] = known = (len(ids), " ".join(map(str, ids)), self.decode(ids))
            self.size += len(word) + len(known[1]) + len(known[2])

    def encode(self, text: str) -> list[int]:
        words = list(self.pieces(text))
        found = self.encode_words({w for w in words if isinstance(w, str)})
        return [i for w in words for i in (found[w] if isinstance(w, str) else [w])]

    def decode(self, ids: Iterable[int]) -> str:
        """As the library without a decoder: tokens joined by a space, special ones too, unknown ids left out."""
        return " ".join(self.tokens[i] for i in ids if i in self.tokens)


def _later_characters() -> re.Pattern:
    kind = unicodedata.ucd_3_2_0.category
    late = [kind(chr(c)) == "Cn" for c in range(0x20000)]
    ends = [c for c in range(1, 0x20000) if late[c] != late[c - 1]] + [0x20000]
    ranges = "".join(f"\\U{a:08x}-\\U{b - 1:08x}" for a, b in zip(ends, ends[1:]) if late[a])
    return re.compile(f"[{ranges}\\U00020000-\\U0010ffff]")


def _lower(text: str) -> str:
    """Lower case of each character by itself; only sigma's depends on its neighbours."""
    return text.replace("\u03a3", "\u03c3").lower()


@functools.lru_cache(maxsize=2)
def word_bpe(path: str) -> WordBpe:
    return WordBpe(path)


ENCODED = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string, ids string, decoded string"


def encode_documents(docs: DataFrame, path: str, whole: bool = True) -> DataFrame:
    """A row for each row of docs: number of ids and SHA-256 of the ids and of the decoded text, both also as texts if whole."""
    fields = ENCODED.split(", ") if whole else ENCODED.split(", ")[:4]
    names = [f.split()[0] for f in fields]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = word_bpe(path)
        for batch in batches:
            for first in range(0, batch.num_rows, 1000):
                part = batch.slice(first, 1000)
                texts = [list(bpe.pieces(t or "")) for t in part.column(1).to_pylist()]
                bpe.learn(texts)
                out = []
                for doc, words in zip(part.column(0).to_pylist(), texts):
                    known = [bpe.known[w] for w in words]
                    ids, decoded = " ".join([k[1] for k in known]), " ".join([k[2] for k in known])
                    out.append((doc, sum(k[0] for k in known), _sha(ids), _sha(decoded), ids, decoded)[: len(names)])
                types = [pa.int64(), pa.int64()] + [pa.string()] * (len(names) - 2)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)

    return docs.select(docs["doc_id"].cast("bigint"), docs["text"]).mapInArrow(rows, ", ".join(fields))


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(documents(spark, sf_dir), tokenizer_path(WORD_BPE), whole=False)
