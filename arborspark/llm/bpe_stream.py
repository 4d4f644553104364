"""BPE encoding and decoding by a bounded-lookahead streaming transducer.

A merge list settles how far to the right a token can depend on text that has not
come yet (:func:`sufficient_lookahead`). The encoder therefore walks a text once,
holds one window of symbols, emits a token as soon as the lookahead behind it is
known, and carries on from the last emitted boundary. Every word goes that way; one that
is shorter than the lookahead is settled when it ends. Both directions are functions of
what they are given, so results of short words are remembered in bounded tables.

Decoding takes the emitted ids, part by part, through an incremental machine whose state is
the bytes that do not make a character yet. A tokenizer file without a decoder gives its
token strings, joined by one space; then each id's bytes are those of its token string.

Defined results: a null text counts as empty; the empty text has no tokens, an empty
id string and an empty decoded text; repeated rows give repeated rows; an empty table
gives an empty table; columns of the input other than the two named ones are dropped.
"""

from __future__ import annotations

import codecs
import hashlib
import json
import re
import unicodedata
from collections.abc import Callable, Iterable, Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame

from arborspark.llm.common import prepare, text_of

#: Distinct pre-tokens, and id sequences of them, that a worker remembers; a table is emptied when it is full.
CACHE_ENTRIES = 1 << 19
#: Characters of a pre-token that is remembered.
CACHE_CHARS = 64
#: Symbols of a sequence that is merged pair by pair, and a rank above all others.
SHORT, NEVER = 64, 1 << 60
#: Characters of text taken at once; a window ends where no word can go on.
WINDOW_CHARS = 1 << 16


def byte_alphabet() -> dict[int, str]:
    """Printable stand-in of each byte: itself if Latin-1 can print it, else 256 and up in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {b: chr(b) for b in plain}
    rest = (b for b in range(256) if b not in out)
    return out | {b: chr(256 + k) for k, b in enumerate(rest)}


def sufficient_lookahead(merges: list[tuple[str, str]], length: Callable[[str], int] = len) -> int:
    """Symbols to the right of a boundary after which no merge can still move it.

    A merge can be prevented, or its operands changed, only by an earlier merge whose
    result overlaps its right end. So news travels leftward along chains of merges of
    falling rank in which a proper prefix of each result is a suffix of the next one's
    left neighbour. The longest such chain, in symbols, bounds the dependence.
    """
    reach: dict[str, int] = {}
    best = 1
    for left, right in merges:
        word = left + right
        depth = length(word) + max((reach.get(word[k:], 0) for k in range(len(word))), default=0)
        best = max(best, depth)
        for k in range(1, len(word) + 1):
            if reach.get(word[:k], 0) < depth:
                reach[word[:k]] = depth
    return best


class Merger:
    """Rank-ordered merging of a symbol sequence, whole or as a stream."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], suffix: str) -> None:
        self.vocab, self.suffix = vocab, suffix
        self.ranks = {(vocab[a], vocab[b]): rank for rank, (a, b) in reversed([*enumerate(merges)])}
        self.made = [vocab[a + b] for a, b in merges]
        size = lambda t: len(t.removesuffix(suffix)) if suffix else len(t)
        self.lookahead = sufficient_lookahead(merges, size)
        self.width = {i: max(1, size(t)) for t, i in vocab.items()}

    def settle(self, ids: list[int]) -> list[int]:
        """Merge the pair of lowest rank, the leftmost first, until none is left.

        Long sequences are gone through once for each rank that occurs, short ones once for each merge.
        """
        get = self.ranks.get
        if len(ids) <= SHORT:
            ranks = [get(p, NEVER) for p in zip(ids, ids[1:], strict=False)]
            while ranks and (low := min(ranks)) != NEVER:
                k = ranks.index(low)
                ids[k : k + 2] = [self.made[low]]
                del ranks[k]
                if k:
                    ranks[k - 1] = get((ids[k - 1], ids[k]), NEVER)
                if k < len(ranks):
                    ranks[k] = get((ids[k], ids[k + 1]), NEVER)
            return ids
        while len(ids) > 1:
            ranks = [get(p, NEVER) for p in zip(ids, ids[1:], strict=False)]
            if (low := min(ranks)) == NEVER:
                break
            ranks.append(NEVER)
            out, k, last = [], 0, len(ids) - 1
            while k <= last:
                hit = ranks[k] == low
                out.append(self.made[low] if hit else ids[k])
                k += 2 if hit else 1
            ids = out
        return ids

    def stream(self, symbols: Iterator[int]) -> Iterator[int]:
        """Tokens of a symbol stream, each emitted once ``lookahead`` symbols stand behind it."""
        held: list[int] = []
        full = 3 * self.lookahead
        while True:
            held += islice(symbols, full - len(held))
            if len(held) < full:
                yield from self.settle(held)
                return
            done, keep = 0, len(held) - self.lookahead
            for t in self.settle(held):
                if done + self.width[t] > keep:
                    break
                done += self.width[t]
                yield t
            held = held[done:]


class WordBPE:
    """A word-end BPE file: NFC, folded white space, lower case, words, byte symbols, merges."""

    #: The file's own split pattern, and the same for text up to U+024F.
    SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
    SPACE = "[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+"
    LETTERS, DIGITS = "A-Za-zªµºÀ-ÖØ-öø-ɏ", "0-9²³¹¼½¾"

    def __init__(self, path: str) -> None:
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.suffix = model["end_of_word_suffix"] or ""
        self.vocab = model["vocab"]
        added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = {i: t for t, i in (self.vocab | added).items()}
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.merger = Merger(self.vocab, merges, self.suffix)
        self.bytes = byte_alphabet()
        self.unbyte = {c: b for b, c in self.bytes.items()}
        self.inner, self.final = ([self.vocab[self.bytes[b] + end] for b in range(256)] for end in ("", self.suffix))
        self.special = added
        self.split_special = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")") if added else None
        self.space = re.compile(self.SPACE)
        gap = "\t-\r \x85\xa0"
        self.near = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{self.LETTERS}]+|[{self.DIGITS}]|[^{gap}{self.LETTERS}{self.DIGITS}]+").findall
        self.far_char = re.compile("[^\x00-ɏ]").search
        self.any = regex.compile(self.SPLIT).findall
        # Cuts that no word crosses and no composition either: before a digit, around ASCII marks, at white space.
        # What follows an apostrophe may belong to it; before ASCII nothing composes.
        mark = r"!-&(-/:-@\[-`{-~"
        self.safe = re.compile(f"[0-9]|(?<=[A-Za-z0-9])[{mark}']|(?<=[{mark}])[A-Za-z]|[ \t-\r]")
        self.shown = {i: t.encode() + b" " for i, t in self.tokens.items()}
        self.known: dict[str, str] = {}
        self.told: dict[str, str] = {}

    def symbols(self, word: str) -> Iterator[int]:
        """Byte symbols of a word, the last with the word-end mark, taken a slice of characters at a time."""
        held = b""
        for at in range(0, len(word), WINDOW_CHARS):
            held += word[at : at + WINDOW_CHARS].encode()
            yield from map(self.inner.__getitem__, held[:-1])
            held = held[-1:]
        yield self.final[held[0]]

    def word_ids(self, word: str) -> Iterator[int]:
        return self.merger.stream(self.symbols(word))

    def windows(self, text: str, start: int = 0, stop: int | None = None) -> Iterator[str]:
        """Pieces of the text, cut so that no word or composition goes across."""
        at, stop = start, len(text) if stop is None else stop
        while stop - at > WINDOW_CHARS:
            found = self.safe.search(text, at + WINDOW_CHARS, stop)
            end = found.start() if found else stop
            yield text[at:end]
            at = end
        yield text[at:stop]

    def words(self, text: str) -> Iterator[list[str]]:
        """Pre-tokens by window; a special string is a pre-token of its own kind (a NUL before it)."""
        at = 0
        for found in self.split_special.finditer(text) if self.split_special else ():
            yield from self.plain_words(text, at, found.start())
            yield ["\0" + found[0]]
            at = found.end()
        yield from self.plain_words(text, at, len(text))

    def plain_words(self, text: str, start: int, stop: int) -> Iterator[list[str]]:
        for piece in self.windows(text, start, stop):
            piece = self.space.sub(" ", unicodedata.normalize("NFC", piece)).replace("Σ", "σ").lower()
            yield self.any(piece) if self.far_char(piece) else self.near(piece)

    def entry(self, word: str) -> str:
        """The ids of a pre-token, joined by one space."""
        if word[0] == "\0" and word[1:] in self.special:
            made = str(self.special[word[1:]])
        else:
            made = " ".join(map(str, self.word_ids(word)))
        if len(self.known) >= CACHE_ENTRIES:
            self.known.clear()
        if len(word) <= CACHE_CHARS:
            self.known[word] = made
        return made

    def encode_chunks(self, text: str) -> Iterator[list[str]]:
        """The ids of each pre-token, joined by one space, window by window."""
        get = self.known.get
        for words in self.words(text):
            if words:
                yield [get(w) or self.entry(w) for w in words]

    def encode(self, text: str) -> list[int]:
        return [int(i) for part in self.encode_chunks(text) for ids in part for i in ids.split(" ")]

    def decode_entry(self, ids: str) -> str:
        """What the machine gives for an id sequence after which no byte is pending."""
        made = self.decode_tokens(map(int, ids.split(" ")))
        if len(self.told) >= CACHE_ENTRIES:
            self.told.clear()
        if len(ids) <= 8 * CACHE_CHARS:
            self.told[ids] = made
        return made

    def decode_chunks(self, chunks: Iterator[list[str]]) -> Iterator[str]:
        """The decoded text of id sequences, part by part, as a file without a decoder has it.

        A token string is whole characters, so no byte is pending behind an id, and the
        text of a sequence does not depend on what was before it but for the joining space.
        """
        get, first = self.told.get, True
        for ids in chunks:
            yield ("" if first else " ") + " ".join([get(i) or self.decode_entry(i) for i in ids])
            first = False

    def machine(self, ids: Iterable[int], bytes_of: Callable[[int], bytes | None]) -> Iterator[str]:
        """Text as it becomes certain: an incremental UTF-8 machine over the ids' bytes.

        An id without bytes is a special string: what is pending before it is closed.
        """
        state = codecs.getincrementaldecoder("utf-8")("replace")
        for i in ids:
            if (raw := bytes_of(i)) is None:
                yield state.decode(b"", True) + self.tokens[i]
                state.reset()
            else:
                yield state.decode(raw)
        yield state.decode(b"", True)

    def decode_tokens(self, ids: Iterable[int]) -> str:
        """As a tokenizer file without a decoder has it: the token strings, joined by one space."""
        return "".join(self.machine(ids, lambda i: self.shown.get(i, b"")))[:-1]

    def decode_text(self, ids: Iterable[int]) -> Iterator[str]:
        """Plain text: each token's bytes, and a space behind a word's end."""

        def bytes_of(i: int) -> bytes | None:
            token = self.tokens.get(i, "")
            if token in self.special:
                return None
            ends = bool(self.suffix) and token.endswith(self.suffix)
            return bytes(self.unbyte[c] for c in (token.removesuffix(self.suffix) if ends else token)) + b" " * ends

        return self.machine(ids, bytes_of)


_loaded: dict[str, WordBPE] = {}


def loaded(path: str) -> WordBPE:
    if path not in _loaded:
        _loaded[path] = WordBPE(path)
    return _loaded[path]


def digest(bpe: WordBPE, text: str) -> tuple[int, str, str]:
    """Token count and the digests of the id text and of the text decoded from it, without holding either."""
    n, ids_hash, text_hash = 0, hashlib.sha256(), hashlib.sha256()

    def emitted() -> Iterator[list[str]]:
        nonlocal n
        for chunk in bpe.encode_chunks(text):
            ids = " ".join(chunk)
            ids_hash.update((" " + ids if n else ids).encode())
            n += ids.count(" ") + 1
            yield chunk

    for piece in bpe.decode_chunks(emitted()):
        text_hash.update(piece.encode())
    return n, ids_hash.hexdigest(), text_hash.hexdigest()


def _by_text(df: DataFrame, id_col: str, text_col: str, one: Callable, names: list[tuple[str, str]], kinds: list[pa.DataType]) -> DataFrame:
    prepare(df.sparkSession)
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [one(t.as_py()) for t in batch.column(1)]
            columns = [pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], [id_col, *[n for n, _ in names]])

    return df.select(id_col, text_of(text_col).alias("text")).mapInArrow(run, ", ".join(f"`{n}` {k}" for n, k in [(id_col, kind), *names]))


def encode_documents(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The ids of every text: ``id_col, n_tokens, ids array<int>``. One map pass, no shuffle."""

    def one(text: str) -> tuple:
        ids = loaded(path).encode(text)
        return len(ids), ids

    return _by_text(df, id_col, text_col, one, [("n_tokens", "bigint"), ("ids", "array<int>")], [pa.int64(), pa.list_(pa.int32())])


def encode_digests(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, n_tokens, ids_sha256, decoded_sha256`` of every text. One map pass, no shuffle."""
    return _by_text(df, id_col, text_col, lambda t: digest(loaded(path), t), [("n_tokens", "bigint"), ("ids_sha256", "string"), ("decoded_sha256", "string")], [pa.int64(), pa.string(), pa.string()])


def decode_documents(df: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Plain text of every id list (null: empty): ``id_col, text``."""
    prepare(df.sparkSession)
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = ["".join(loaded(path).decode_text(iter(x.as_py() or []))) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], [id_col, "text"])

    return df.select(id_col, ids_col).mapInArrow(run, f"`{id_col}` {kind}, text string")
