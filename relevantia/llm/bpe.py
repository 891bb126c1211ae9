"""BPE encoding and decoding by traversal of a prefix-sharing trie of words.

The distinct words of a batch go into a trie. Going down the trie, each node gets the
last token of the encoding of its prefix: the longest vocabulary entry that ends there
and stays separate, under the merge order, from the last token of what precedes it.
That state is all that longer words need, so a prefix that many words share is encoded
once. A word's encoding is read back from its end node, last token by last token.

The last symbol of a word carries the end mark, so it is another symbol than the same
byte inside a word, and each word ends in an edge of its own. Which tokens can end at a
node depends on its last symbols; what a window of WINDOW of them allows is looked up in
the vocabulary once, as is whether two tokens stay separate side by side.

Texts are cut into words as the tokenizer file says: canonical composition, white
space, lower case and the cut pattern. The library's own normaliser and splitter do it
wherever a text holds a character for which Python and the library could differ. Lists
of ids are made from plain texts by their bytes, all texts of a chunk at once.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from array import array
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from itertools import chain
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship
from .common import table, text_of

#: ASCII and Latin letters that are composed already and lower-case alike everywhere.
_PLAIN = re.compile("[\t-\r\x20-\x7e\xa1-\xac\xae-įı-ňŊ-ž–—‘-„…€]*")
_CHARS = [c for c in map(chr, [*range(9, 14), *range(32, 127), *range(161, 383), *map(ord, "–—‘’“”„…€")]) if _PLAIN.fullmatch(c)]
_LETTERS = "".join(c for c in _CHARS if unicodedata.category(c)[0] == "L")
_NUMBERS = "".join(c for c in _CHARS if unicodedata.category(c)[0] == "N")
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: The words, windows of symbols and pairs of tokens kept between batches; beyond it a table
#: starts anew. Results do not depend on it.
KEPT_WORDS, KEPT_WINDOWS, KEPT_PAIRS = 200_000, 200_000, 400_000
WINDOW = 4
#: What a byte belongs to; _PAST: a character that is not plain.
_SPACE, _LETTER, _NUMBER, _SIGN, _PAST = range(5)
#: The words of one call of the library.
LIBRARY_WORDS = 128
#: The bytes of the words in a table of ids: long words never overflow its offsets.
KEPT_BYTES = 64 << 20


def word_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, extra = [""] * 256, 0
    for b in range(256):
        if b in shown:
            out[b] = chr(b)
        else:
            out[b] = chr(256 + extra)
            extra += 1
    return out


@lru_cache(maxsize=1)
def _byte_tables() -> tuple[np.ndarray, ...]:
    """Of plain characters, kind and lower case: by byte for one byte, by the last 11 bits of the code point for two, kind alone by its last 12 bits for three bytes that begin with E2."""
    kind1, low1 = np.full(256, _PAST, np.uint8), np.arange(256, dtype=np.uint8)
    kind2, low2 = np.full(1 << 11, _PAST, np.uint8), np.zeros((1 << 11, 2), np.uint8)
    kind3 = np.full(1 << 12, _PAST, np.uint8)
    for c in _CHARS:
        own, low = c.encode(), c.lower().encode()
        kind = _SPACE if c.isspace() else _LETTER if c in _LETTERS else _NUMBER if c in _NUMBERS else _SIGN
        if len(own) == len(low) == 1:
            kind1[ord(c)], low1[ord(c)] = kind, low[0]
        elif len(own) == len(low) == 2:
            kind2[ord(c)], low2[ord(c)] = kind, list(low)
        elif own == low and own[0] == 0xE2:
            kind3[ord(c) & 0xFFF] = kind
    return kind1, low1, kind2, low2, kind3


def _ended(symbols: str) -> str:
    return symbols[:-1] + chr(256 + ord(symbols[-1]))


def _shared(leaves: list[str], width: int = 32) -> list[int]:
    """How many symbols each of the sorted strings shares with the one before it."""
    if not leaves:
        return []
    x = np.array([s[:width] for s in leaves]).view(np.uint32).reshape(len(leaves), -1)
    apart = x[1:] != x[:-1]
    out = [0, *np.where(apart.any(axis=1), apart.argmax(axis=1), width).tolist()]
    for i in np.flatnonzero(~apart.any(axis=1)).tolist():
        a, b = leaves[i], leaves[i + 1]
        out[i + 1] = next((k for k, (p, q) in enumerate(zip(a, b)) if p != q), min(len(a), len(b)))
    return out


class WordBpe:
    """Word-level BPE from a tokenizers file: encodes words, texts; decodes ids."""

    def __init__(self, path: str):
        from tokenizers import Regex, Tokenizer, pre_tokenizers

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.end: str = model["end_of_word_suffix"]
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.tokens = {i: t for t, i in [*self.vocab.items(), *self.special.items()]}
        self._library = Tokenizer.from_file(path)
        self._library.no_truncation()
        self._library.no_padding()
        self._normal = self._library.normalizer.normalize_str
        self._cut_words = Tokenizer.from_str(json.dumps(spec | {"normalizer": None, "truncation": None, "padding": None}))
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        if pattern != _PATTERN:
            raise ValueError(f"another cut pattern than {_PATTERN}: {pattern}")
        # Letters first: no other alternative begins with one.
        own = r"[\p{L}]+|" + _PATTERN.replace(r"[\p{L}]+|", "")
        self._cut = re.compile(own.replace(r"[\p{L}]", f"[{_LETTERS}]").replace(r"[\p{N}]", f"[{_NUMBERS}]").replace(r"\p{L}\p{N}", _LETTERS + _NUMBERS)).findall
        self._library_cut = pre_tokenizers.Split(Regex(pattern), "removed", invert=True).pre_tokenize_str
        self._split_special = re.compile("(" + "|".join(map(re.escape, self.special)) + ")").split
        self._letters = _byte_letters()
        #: merges: (left, right) -> rank; parts: token -> (rank, left, right)
        self.merges: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int, int]] = {}
        for rank, (a, b) in enumerate(model["merges"]):
            left, right, joined = self.vocab[a], self.vocab[b], self.vocab[a + b]
            if joined in self.parts or (left, right) in self.merges:
                raise ValueError("two merges make the same token: last-token states do not determine encodings")
            self.merges[left, right] = rank
            self.parts[joined] = (rank, left, right)
        #: tokens by their symbols: bytes as characters, the last one from 256 on if it carries the end mark
        self._by_symbols: dict[str, int] = {}
        byte = {letter: chr(b) for b, letter in enumerate(self._letters)}
        for t, i in self.vocab.items():
            if i < 2 * 256 or i in self.parts:
                ended = t.endswith(self.end) and len(t) > len(self.end)
                symbols = "".join(byte[c] for c in (t[: -len(self.end)] if ended else t))
                self._by_symbols[_ended(symbols) if ended else symbols] = i
        #: lengths of the tokens longer than a window, longest first, by their last WINDOW symbols
        longer: dict[str, set[int]] = {}
        for t in self._by_symbols:
            if len(t) > WINDOW:
                longer.setdefault(t[-WINDOW:], set()).add(len(t))
        self._longer = {k: sorted(v, reverse=True) for k, v in longer.items()}
        self._windows: dict[str, list[tuple[int, int, dict[int, bool]]]] = {}
        #: token -> token before it -> whether both stay separate
        self._fits: dict[int, dict[int, bool]] = {}
        self._n_fits = 0
        self._tables: dict[Any, Words] = {}
        self._word_ids: dict[Any, WordIds] = {}
        self._ends: np.ndarray | None = None

    def _apart(self, left: int, right: int) -> bool:
        """Whether left and right, side by side, both survive the merges of their joint text.

        Takes the two apart in reverse merge order. At each step the pair at the seam must
        not have a merge that comes before the merges that formed its neighbours.
        """
        a, b, limit = left, right, 1 << 60
        while True:
            rank = self.merges.get((a, b))
            if rank is not None and rank < limit:
                return False
            pa_, pb = self.parts.get(a), self.parts.get(b)
            if pa_ is None and pb is None:
                return True
            # The later merge is undone first; of equal ones (the same token twice) the left is made first.
            if pb is None or (pa_ is not None and pa_[0] > pb[0]):
                limit, a = pa_[0], pa_[2]
            else:
                limit, b = pb[0] + 1, pb[1]

    def _window(self, symbols: str) -> list[tuple[int, int, dict[int, bool]]]:
        """What can end after these symbols, the last WINDOW at most: (length, token, its entry of _fits), longest first.

        A length above the window's has the token -1: whether there is one depends on the symbols before.
        """
        out: list[tuple[int, int, dict[int, bool]]] = [(n, -1, {}) for n in self._longer.get(symbols, ())]
        for n in range(len(symbols), 0, -1):
            token = self._by_symbols.get(symbols[-n:])
            if token is not None:
                out.append((n, token, self._fits.setdefault(token, {})))
        self._windows[symbols] = out
        return out

    def _fit(self, left: int, token: int) -> bool:
        found = self._fits.setdefault(token, {})[left] = self._apart(left, token)
        self._n_fits += 1
        return found

    def encode_words(self, words: Iterable[str]) -> Iterator[tuple[str, list[int]]]:
        """Each distinct word with its ids, by one traversal of their trie. A word is not empty.

        Words sorted by symbols are the trie's leaves in depth-first order: going from one to
        the next, the states of the prefix that both share stand and only new nodes are worked out.
        """
        if len(self._windows) > KEPT_WINDOWS or self._n_fits > KEPT_PAIRS:
            self._windows, self._fits, self._n_fits = {}, {}, 0
        by_symbols, windows, fits_of, window, fit = self._by_symbols, self._windows, self._fits, self._window, self._fit
        of = {_ended(w if w.isascii() else w.encode("utf-8").decode("latin-1")): w for w in words}
        leaves = sorted(of)
        last, size = [-1], [0]
        for symbols, shared in zip(leaves, _shared(leaves)):
            n = len(symbols)
            del last[shared + 1 :], size[shared + 1 :]
            for depth in range(shared + 1, n + 1):
                near = symbols[depth - WINDOW : depth] if depth > WINDOW else symbols[:depth]
                for length, token, fits in windows.get(near) or window(near):
                    if token < 0:
                        if length > depth:
                            continue
                        token = by_symbols.get(symbols[depth - length : depth])
                        if token is None:
                            continue
                        fits = fits_of.setdefault(token, {})
                    if length == depth:
                        break
                    left = last[depth - length]
                    known = fits.get(left)
                    if known or (known is None and fit(left, token)):
                        break
                else:
                    raise ValueError(f"no token ends at {symbols[:depth]!r}")
                last.append(token)
                size.append(length)
            ids, at = [], n
            while at:
                ids.append(last[at])
                at -= size[at]
            ids.reverse()
            yield of[symbols], ids

    def words(self, text: str) -> list[str]:
        """The words of a text without special tokens."""
        if _PLAIN.fullmatch(text):
            return self._cut(text.lower())
        return [w for w, _ in self._library_cut(self._normal(text))]

    def pieces(self, text: str) -> list[str]:
        """Words, and special tokens, which are found in the raw text; no word is like one, since letters and signs are cut apart."""
        if "<|" not in text:
            return self.words(text)
        out: list[str] = []
        for part in self._split_special(text):
            if part in self.special:
                out.append(part)
            elif part:
                out.extend(self.words(part))
        return out

    def all_pieces(self, texts: pa.StringArray) -> tuple[pa.StringArray, np.ndarray]:
        """The pieces of all texts in a row, as pieces() has them, and where each text's begin (one more than texts). No text is null.

        Plain texts are cut by their bytes: a piece begins where the kind of character
        changes, at each number and at the start of a text.
        """
        at = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
        raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[at[0] : at[-1]]
        at -= at[0]
        if not len(raw):
            return pa.array([], pa.string()), np.zeros(len(at), np.int64)
        kind1, low1, kind2, low2, kind3 = _byte_tables()
        kind, low = kind1[raw], low1[raw]
        lead = np.flatnonzero(raw >= 0xC0)
        two = lead[raw[lead] < 0xE0]
        code = (raw[two].astype(np.int32) & 0x1F) << 6 | raw[two + 1] & 0x3F
        kind[two] = kind[two + 1] = kind2[code]
        # Characters that are not plain have no lower case here: their texts are left out below.
        low[two], low[two + 1] = low2[code].T
        three = lead[raw[lead] == 0xE2]
        code = (raw[three + 1].astype(np.int32) & 0x3F) << 6 | raw[three + 2] & 0x3F
        kind[three] = kind[three + 1] = kind[three + 2] = kind3[code]

        special = np.flatnonzero(raw[:-1] == ord("<"))
        special = special[raw[special + 1] == ord("|")]
        past = np.unique(np.searchsorted(at, np.concatenate([np.flatnonzero(kind == _PAST), special]), "right") - 1)
        for i in past.tolist():
            kind[at[i] : at[i + 1]] = _SPACE

        begins = np.empty(len(raw), bool)
        begins[0] = True
        np.not_equal(kind[1:], kind[:-1], out=begins[1:])
        begins |= (kind == _NUMBER) & (raw & 0xC0 != 0x80)
        begins[at[:-1][at[:-1] < len(raw)]] = True
        self._shorten(low, begins, at)
        solid = kind != _SPACE
        begins &= solid
        data = low[solid]
        starts = np.flatnonzero(begins[solid])
        words = pa.StringArray.from_buffers(len(starts), pa.py_buffer(np.append(starts, len(data)).astype(np.int32)), pa.py_buffer(data))
        first = np.searchsorted(np.flatnonzero(begins), at)
        if not len(past):
            return words, first
        cut = [self.pieces(texts[i].as_py()) for i in past.tolist()]
        counts = np.diff(first)
        rows = np.concatenate([np.repeat(np.arange(len(texts)), counts), np.repeat(past, [*map(len, cut)])])
        counts[past] = [*map(len, cut)]
        words = pa.concat_arrays([words, pa.array(chain.from_iterable(cut), pa.string())])
        return words.take(pa.array(np.argsort(rows, kind="stable"))), np.concatenate([[0], np.cumsum(counts)])

    @staticmethod
    def _shorten(low: np.ndarray, begins: np.ndarray, at: np.ndarray) -> None:
        """In begins, an apostrophe that begins a piece takes s, t, m, d, re, ve or ll with it."""
        signs = np.flatnonzero((low == ord("'")) & begins)
        ends = at[np.searchsorted(at, signs, "right")]
        # Beyond the end: no letter.
        one = np.where(signs + 1 < ends, low[np.minimum(signs + 1, len(low) - 1)], 0)
        two = np.where(signs + 2 < ends, low[np.minimum(signs + 2, len(low) - 1)], 0)
        short = np.isin(one, list(b"stmd"))
        long = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
        begins[signs[short | long] + 1] = False
        after = np.concatenate([signs[short] + 2, signs[long] + 3])
        begins[after[after < len(low)]] = True

    def library_words(self, words: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of distinct words in a row and how many each has, by the tokenizers library: words parted by spaces; each ends in a token with the end mark.

        Words come normalised, and normalising again could change them (lower-casing can leave
        what composes anew), so that the library's tokenizer here has no normaliser.
        """
        if self._ends is None:
            self._ends = np.zeros(max(self.tokens) + 1, bool)
            self._ends[[i for t, i in self.vocab.items() if t.endswith(self.end)]] = True
        at = np.append(np.arange(0, len(words), LIBRARY_WORDS), len(words)).astype(np.int32)
        rows = pc.binary_join(pa.ListArray.from_arrays(pa.array(at), words), " ").to_pylist()
        ids = [np.array(self._cut_words.encode_batch_fast([r], add_special_tokens=False)[0].ids, np.int32) for r in rows]
        ends = [np.flatnonzero(self._ends[x]) for x in ids]
        if [*map(len, ends)] != np.diff(at).tolist():
            raise ValueError("the library cuts words otherwise")
        # Each call's ids end with a word's end.
        return np.concatenate([np.zeros(0, np.int32), *ids]), np.concatenate([np.zeros(0, np.int64), *(np.diff(e, prepend=-1) for e in ends)])

    def trie_words(self, words: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """The same by encode_words()."""
        of = dict(self.encode_words(words.to_pylist()))
        lists = [of[w] for w in words.to_pylist()]
        return np.array([*chain.from_iterable(lists)], np.int32), np.array([*map(len, lists)], np.int64)

    def table(self, *forms: Callable[[list[int]], Any], library: bool = False, keep: int = KEPT_WORDS) -> Words:
        """The table of these forms, kept between batches."""
        key = (*forms, library, keep)
        if key not in self._tables:
            self._tables[key] = Words(self, forms, library, keep)
        return self._tables[key]

    def word_ids(self, library: bool, keep: int) -> WordIds:
        """The table of ids, kept between batches."""
        if (library, keep) not in self._word_ids:
            self._word_ids[library, keep] = WordIds(self, library, keep)
        return self._word_ids[library, keep]

    def encode(self, text: str) -> list[int]:
        (cut,), (ids,) = self.table(list).take([text])
        return [i for piece in cut for i in ids[piece]]

    def decimal(self, ids: list[int]) -> str:
        return " ".join(map(str, ids))

    def decode(self, ids: Iterable[int]) -> str:
        """As the file has no decoder: tokens joined by spaces, unknown ids left out."""
        return " ".join([self.tokens[i] for i in ids if i in self.tokens])


class Words:
    """A table of words and special tokens with what each form makes of a word's ids; each word is encoded once."""

    def __init__(self, bpe: WordBpe, forms: tuple[Callable[[list[int]], Any], ...], library: bool, keep: int):
        self.bpe, self.forms, self.library, self.keep = bpe, forms, library, keep
        self.of: list[dict[str, Any]] = [{} for _ in forms]

    def cover(self, every: set[str]) -> list[dict[str, Any]]:
        """A dict by word for each form; they have every one of these words.

        library: words by library_words() instead of the trie.
        """
        new = every.difference(self.of[0])
        if len(self.of[0]) + len(new) > self.keep:
            # Words that this batch has are likely to come again.
            self.of = [{w: have[w] for w in every if w in have} for have in self.of]
        special = new.intersection(self.bpe.special)
        new -= special
        for form, have in zip(self.forms, self.of):
            have.update((w, form([self.bpe.special[w]])) for w in special)
        pairs = list(zip(self.forms, self.of))
        if self.library:
            ids, sizes = self.bpe.library_words(pa.array(new, pa.string()))
            lists = zip(new, map(np.ndarray.tolist, np.split(ids, np.cumsum(sizes)[:-1])))
        else:
            lists = self.bpe.encode_words(new)
        for word, ids in lists:
            for form, have in pairs:
                have[word] = form(ids)
        return self.of

    def take(self, texts: list[str]) -> tuple[list[list[str]], list[dict[str, Any]]]:
        """The pieces of each text, and cover() of them."""
        cut = list(map(self.bpe.pieces, texts))
        return cut, self.cover(set().union(*cut))


class WordIds:
    """A table of words and special tokens with their ids as arrays; each word is encoded once, by the library or the trie."""

    def __init__(self, bpe: WordBpe, library: bool, keep: int):
        self.encode, self.keep = bpe.library_words if library else bpe.trie_words, keep
        self.special = pa.array(bpe.special, pa.string())
        self.words, self.ids, self.sizes = self.special, np.array([*bpe.special.values()], np.int32), np.ones(len(bpe.special), np.int64)

    def find(self, words: pa.StringArray) -> np.ndarray:
        """Where in ``sizes`` each of these distinct words is; what was found before no longer holds."""
        known = pc.index_in(words, value_set=self.words)
        at = known.fill_null(-1).to_numpy().astype(np.int64)
        if not known.null_count:
            return at
        new, more = at < 0, words.filter(known.is_null())
        if len(self.words) + len(more) > self.keep or self.words.nbytes + more.nbytes > KEPT_BYTES:
            # Words that this batch has are likely to come again; special tokens stay.
            kept = np.union1d(np.arange(len(self.special)), at[~new])
            self.ids, self.words, self.sizes = self.take(kept), self.words.take(pa.array(kept)), self.sizes[kept]
            at[~new] = np.searchsorted(kept, at[~new])
        at[new] = len(self.words) + np.arange(len(more))
        ids, sizes = self.encode(more)
        self.words, self.ids, self.sizes = pa.concat_arrays([self.words, more]), np.concatenate([self.ids, ids]), np.concatenate([self.sizes, sizes])
        return at

    def take(self, at: np.ndarray) -> np.ndarray:
        """The ids of the words at these places, in a row."""
        sizes = self.sizes[at]
        # Where each word's ids begin in the table, less where they begin in the result.
        shift = np.repeat((np.cumsum(self.sizes) - self.sizes)[at] - (np.cumsum(sizes) - sizes), sizes)
        return self.ids[np.arange(len(shift)) + shift]


@lru_cache(maxsize=2)
def loaded(path: str) -> WordBpe:
    return WordBpe(path)


def chunks(batch: pa.RecordBatch, column: str, chars: int = 4_000_000) -> Iterator[tuple[int, list[str]]]:
    """Runs of rows with about so many characters, by first row."""
    start, size, out = 0, 0, []
    for n, text in enumerate(batch.column(batch.schema.get_field_index(column)).to_pylist()):
        text = text or ""
        out.append(text)
        size += len(text)
        if size >= chars:
            yield start, out
            start, size, out = n + 1, 0, []
    if out:
        yield start, out


def packed(ids: list[int]) -> bytes:
    return array("i", ids).tobytes()


def slices(batch: pa.RecordBatch, column: str, size: int = 4_000_000) -> Iterator[tuple[int, pa.StringArray]]:
    """Runs of rows with about so many bytes, by first row; null is empty."""
    texts = batch.column(batch.schema.get_field_index(column)).cast(pa.string())
    if texts.null_count:
        texts = texts.fill_null("")
    at = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int32)
    start = 0
    while start < len(texts):
        end = max(start + 1, int(np.searchsorted(at, int(at[start]) + size)))
        yield start, texts.slice(start, min(end, len(texts)) - start)
        start = end


def id_lists(bpe: WordBpe, texts: pa.StringArray, end: int | None = None, library: bool = False, keep: int = KEPT_WORDS) -> pa.ListArray:
    """The ids of each text, and ``end`` after them, as an Arrow list array; words by the trie or by the library, ``keep`` of them at most kept between calls.

    Words become codes of a dictionary, whose ids lie in one array; each text gathers its own.
    """
    cut, first = bpe.all_pieces(texts)
    flat, table = cut.dictionary_encode(), bpe.word_ids(library, keep)
    words = table.find(flat.dictionary)[flat.indices.to_numpy()]
    out, at = table.take(words), np.concatenate([[0], np.cumsum(table.sizes[words])])[first]
    if end is not None:
        out, at = np.insert(out, at[1:], end), at + np.arange(len(at))
    return pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(out.astype(np.int32, copy=False)))


def _digests(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path)
        schema = pa.schema([("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])
        for batch in batches:
            for start, texts in chunks(batch, "text", 2_000_000):
                rows = []
                cut, (decimal, shown) = bpe.table(bpe.decimal, bpe.decode).take(texts)
                for c in cut:
                    ids, decoded = (" ".join(map(of.__getitem__, c)) for of in (decimal, shown))
                    rows.append((ids.count(" ") + bool(ids), hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()))
                cols = [pa.array(c, f.type) for c, f in zip(zip(*rows), schema)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, len(texts)), *cols], [batch.schema.field(0).name, *schema.names])

    return run


def bpe_digests(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """Per row id, ``n_tokens``, and the SHA-256 of the ids (decimal, joined by a space) and of the decoded text.

    A null text is empty: 0 tokens, and both digests those of the empty string. Ids may
    be null or repeat. An empty table gives an empty result; other columns are not carried.
    """
    ship(df.sparkSession)
    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(df[id_col].alias(id_col), text_of(df, text_col).alias("text"))
    return rows.mapInArrow(_digests(path or word_file()), f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def _encode(path: str):
    def run(batches):
        bpe = loaded(path)
        for batch in batches:
            for start, texts in slices(batch, "text"):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, len(texts)), id_lists(bpe, texts)], [batch.schema.field(0).name, "ids"])

    return run


def encode(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """Per row id and ``ids``. Cases as in bpe_digests()."""
    ship(df.sparkSession)
    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(df[id_col].alias(id_col), text_of(df, text_col).alias("text"))
    return rows.mapInArrow(_encode(path or word_file()), f"`{id_col}` {kind}, ids array<int>")


def decode(df: DataFrame, ids_col: str = "ids", path: str | None = None) -> DataFrame:
    """df with ``decoded``, the text of an ids column; null ids give null, unknown ids are left out."""
    ship(df.sparkSession)
    file = path or word_file()

    @F.pandas_udf("string")
    def text(s):
        bpe = loaded(file)
        return s.map(lambda ids: None if ids is None else bpe.decode(ids))

    return df.withColumn("decoded", text(df[ids_col]))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_digests(table(spark, sf_dir, "documents").select("doc_id", "text"))
