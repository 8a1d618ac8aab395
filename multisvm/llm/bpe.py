"""BPE encoding by a bounded-lookahead streaming transducer, and decoding.

The tokenizer file (a parameter, read from its path by each worker) gives
symbols and a merge list. Text is NFC-normalized and lower-cased character by
character, white space separates, and the pieces of the file's split pattern
are encoded one by one; a piece's last symbol carries the end-of-word mark.

``Transducer`` reads a piece symbol by symbol. The encoding of a prefix is the
encoding of a shorter prefix and one more token, so a position needs one back
pointer: the longest token that ends there and may follow the token before it
(two tokens may stand side by side if encoding their concatenation gives the
two back). A later token starts at most ``lookahead`` symbols back, the
longest token of the merge list, so tokens that all open positions share are
stable: they are emitted and forgotten, and memory stays constant.

Frequent pieces are remembered in a bounded table (cleared when full).

Decoding is a state machine over ids: ``pieces`` gives the file's own form,
token strings joined by a space (the file names no decoder); ``text`` turns
bytes into UTF-8 text as they complete and end-of-word marks into spaces.

Defined cases: null and empty texts have no tokens and decode to an empty
text; an added token's string in a text is that token, as in the library;
repeated rows each get a row; other columns are not read; an empty table gives
an empty result.
"""

from __future__ import annotations

import codecs
import hashlib
import json
import os
import re
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache
from struct import pack

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from multisvm.llm.common import workers

REMEMBERED = 400_000  # pieces and words of the bounded tables
FAMILIAR = "\u024f"  # last letter of the Latin blocks whose classes do not differ between Unicode versions
# The split pattern on lower-cased ASCII without an apostrophe.
_ASCII_PIECES = re.compile(r"[a-z]+|[0-9]|[^a-z0-9 \t-\r]+").findall
CHUNK = 1 << 18  # characters of a text that are taken at once


def byte_symbols() -> list[str]:
    """The symbol of each byte: printable Latin-1 characters stand for
    themselves, the others for 256, 257, ... in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return [chr(b) if b in plain else chr(256 + rest.index(b)) for b in range(256)]


class Transducer:
    """Streaming encoder of one piece after another.

    Inside, a piece is a string of byte symbols and, at its end, ``MARK`` for
    the end-of-word mark; tokens are strings of the same kind.
    """

    MARK = "\0"

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], end: str = "</w>"):
        def own(token: str) -> str:
            return token[: -len(end)] + self.MARK if end and token.endswith(end) and token != end else token

        self.ids = {own(t): i for t, i in vocab.items()}
        self.rank: dict[tuple[str, str], int] = {}
        self.made: dict[str, tuple[int, str, str]] = {}  # rank and halves of the merge that makes a token
        for i, (a, b) in enumerate(merges):
            a, b = own(a), own(b)
            self.rank.setdefault((a, b), i)
            self.made.setdefault(a + b, (i, a, b))
        # lengths of the tokens that end with the same three symbols (or are shorter), longest first
        sizes: dict[str, set[int]] = {}
        for t in self.ids:
            sizes.setdefault(t[-3:], set()).add(len(t))
        for k, own_sizes in sizes.items():
            own_sizes.update(len(k[i:]) for i in range(1, len(k)) if k[i:] in self.ids)
        self.sizes = {k: sorted(v, reverse=True) for k, v in sizes.items()}
        self.lookahead = max(map(len, self.ids))
        self._left: str | None = None
        self._known: dict[tuple[str, str], bool] = {}  # bounded, as all tables

    def follows(self, a: str, b: str) -> bool:
        """May token b stand after token a? Their last merges are undone, the
        later one first; the two may not if what then meets at the boundary
        would have merged before (on equal ranks the left merge is first)."""
        rank, made = self.rank, self.made
        bound = 1 << 60
        while True:
            if rank.get((a, b), 1 << 60) < bound:
                return False
            of_a, of_b = made.get(a), made.get(b)
            if of_a is None and of_b is None:
                return True
            if of_b is None or of_a is not None and of_a[0] > of_b[0]:
                bound, a = of_a[0], of_a[2]
            else:
                bound, b = of_b[0] + 1, of_b[1]

    def encode(self, piece: str) -> Iterator[str]:
        """Tokens of a piece, each as soon as it is stable."""
        self._left = None
        window = ""  # symbols since the last stable position
        back: list[tuple[str, int] | None] = []  # at each position: its last token and that token's start
        ids, sizes, follows, enough = self.ids, self.sizes, self.follows, 4 * self.lookahead
        known = self._known
        if len(known) > REMEMBERED:
            known.clear()
        last = len(piece)
        for i in range(last + 1):
            window += piece[i] if i < last else self.MARK
            n = len(window)
            found = None
            for size in sizes.get(window[-3:]) or sizes.get(window[-2:]) or (1,):
                start = n - size
                if start < 0:
                    continue
                token = window[start:]
                if token not in ids:
                    continue
                if start:
                    before = back[start - 1]
                    if before is None:
                        continue
                    both = before[0], token
                    may = known.get(both)
                    if may is None:
                        may = known[both] = follows(*both)
                    if not may:
                        continue
                elif self._left is not None and not follows(self._left, token):
                    continue
                found = (token, start)
                break
            back.append(found)
            if n >= enough and i < last:
                out = self._settle(back)
                if out:
                    window = window[sum(map(len, out)):]
                    yield from out
        yield from self._path(back, len(window))

    def _path(self, back, end: int) -> list[str]:
        out = []
        while end:
            token, start = back[end - 1]
            out.append(token)
            end = start
        return out[::-1]

    def _settle(self, back) -> list[str]:
        """The tokens up to the last position that every open one goes through
        (a later token starts at most ``lookahead`` symbols back)."""
        n = len(back)
        live = {p for p in range(max(1, n - self.lookahead + 1), n + 1) if back[p - 1] is not None}
        while len(live) > 1:
            top = max(live)
            live.discard(top)
            live.add(back[top - 1][1])
        stable = live.pop()
        if not stable:
            return []
        out = self._path(back, stable)
        # a position whose last token began before the stable one is on no path
        back[:] = [b if b is None else (b[0], b[1] - stable) for b in back[stable:]]
        back[:] = [b if b is not None and b[1] >= 0 else None for b in back]
        self._left = out[-1]
        return out


class Codec:
    """Encoder and decoder of one tokenizer file."""

    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.vocab: dict[str, int] = model["vocab"]
        self.end = model.get("end_of_word_suffix") or ""
        self.transducer = Transducer(self.vocab, merges, self.end)
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.hint = os.path.commonprefix(list(self.added)) if self.added else "\0no added token"
        kinds = spec["pre_tokenizer"]["pretokenizers"]
        self.pattern = regex.compile(next(k["pattern"]["Regex"] for k in kinds if k["type"] == "Split"))
        self.special = regex.compile("|".join(regex.escape(t) for t in sorted(self.added, key=len, reverse=True)) or r"(?!)")
        self.decimals = list(map(str, range(1 + max([*self.vocab.values(), *self.added.values()]))))
        self.strings = {i: t for t, i in [*self.vocab.items(), *self.added.items()]}
        self.bytes = byte_symbols()
        self.of_symbol = {s: bytes([b]) for b, s in enumerate(self.bytes)}
        self._pieces: dict[str, bytes] = {}
        self.path, self._library = path, None

    def _encode(self, symbols: str) -> list[int]:
        """Ids of a piece given by its byte symbols."""
        known = self.transducer.ids
        return [known[t] for t in self.transducer.encode(symbols)]

    def _piece(self, piece: str) -> bytes:
        """A piece's ids, packed as little-endian uint32."""
        packed = self._pieces.get(piece)
        if packed is None:
            plain = piece.isascii() and piece.isprintable()
            ids = self._encode(piece if plain else "".join([self.bytes[b] for b in piece.encode()]))
            packed = pack("<%dI" % len(ids), *ids)
            if len(piece) <= 64:
                if len(self._pieces) >= REMEMBERED:
                    self._pieces.clear()
                self._pieces[piece] = packed
        return packed

    def word(self, word: str) -> bytes:
        """Packed ids of a stretch without white space."""
        if self.hint not in word:
            return self._plain(word)
        out: list[bytes] = []
        at = 0
        for m in self.special.finditer(word):
            out += [self._plain(word[at:m.start()]), pack("<I", self.added[m.group()])]
            at = m.end()
        return b"".join([*out, self._plain(word[at:])])

    def _plain(self, text: str) -> bytes:
        if text.isascii():
            text = text.lower()
            if text.isalpha():
                return self._piece(text)
            pieces = _ASCII_PIECES(text) if "'" not in text else self.pattern.findall(text)
        elif max(text) <= FAMILIAR:
            # lower-cased by character, so that no letter depends on the word around it
            text = unicodedata.normalize("NFC", text).lower()
            if text.isalpha():
                return self._piece(text)
            pieces = self.pattern.findall(text)
        else:
            # letter classes and cases of rarer scripts as the library's Unicode version has them
            pieces = self._library_pieces(text)
        return b"".join(map(self._piece, pieces))

    def rest(self) -> None:
        """Give up the bounded tables (a worker may be idle, or do other work, after its task)."""
        self._pieces.clear()
        self.transducer._known.clear()

    def _library_pieces(self, text: str) -> list[str]:
        if self._library is None:
            from tokenizers import Tokenizer

            self._library = Tokenizer.from_file(self.path)
        split = self._library.pre_tokenizer.pre_tokenize_str(self._library.normalizer.normalize_str(text))
        return [b"".join(self.of_symbol[c] for c in piece).decode() for piece, _ in split]

    def words(self, text: str) -> Iterator[list[str]]:
        """The text's white-space separated stretches, some at a time."""
        at, n = 0, len(text)
        if not any(c in text for c in "\x1c\x1d\x1e\x1f"):  # str.split() takes these for white space
            while at < n:
                to = min(n, at + CHUNK)
                while to < n and not text[to].isspace():
                    to += 1
                yield text[at:to].split()
                at = to
        else:
            import regex

            for m in regex.finditer(r"\S+", text):
                yield [m.group()]

    # -- decoding

    def pieces(self, chunks: Iterable[list[int]]) -> Iterator[str]:
        """Token strings joined by a space, chunk by chunk of ids."""
        glue, string = "", self.strings.__getitem__
        for ids in chunks:
            if ids:
                yield glue + " ".join(map(string, ids))
                glue = " "

    def text(self, ids: Iterable[int]) -> Iterator[str]:
        """Text as soon as its bytes complete characters."""
        state = codecs.getincrementaldecoder("utf-8")("replace")
        end = self.end
        for i in ids:
            token = self.strings[i]
            if token in self.added:
                yield state.decode(b"", True) + token
                state.reset()
                continue
            whole = bool(end) and token.endswith(end)
            body = token[: -len(end)] if whole else token
            yield state.decode(b"".join(self.of_symbol[c] for c in body)) + (" " if whole else "")
        yield state.decode(b"", True)


class Words(dict):
    """Encoded words as packed little-endian uint32 ids, in a bounded table of
    two generations: when the young one is full it becomes the old one, from
    which words that come again move back without being encoded anew."""

    def __init__(self, encode):
        super().__init__()
        self.encode, self.old = encode, {}

    def __missing__(self, word: str) -> bytes:
        out = self.old.get(word)
        if out is None:
            out = self.encode(word)
            if len(word) > 64:
                return out
        if len(self) >= REMEMBERED:
            self.old = dict(self)
            self.clear()
        self[word] = out
        return out

    def rest(self) -> None:
        """Give up all words (a worker may be idle, or do other work, after its task)."""
        self.clear()
        self.old = {}


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


@lru_cache(maxsize=2)
def encoded_words(path: str) -> Words:
    return Words(codec(path).word)


def encode_stream(path: str, text: str) -> Iterator:
    """The text's ids as uint32 arrays, chunk by chunk."""
    import numpy as np

    known = encoded_words(path)
    for words in codec(path).words(text):
        yield np.frombuffer(b"".join(map(known.__getitem__, words)), "<u4")


def _mapped(df: DataFrame, id_col: str, col: str, kind: str, fields: str, row, held=tuple) -> DataFrame:
    """``row(value)`` of every row's ``col`` as columns ``fields``, beside the
    id; ``held()`` names tables that need not outlast the task."""
    workers(df.sparkSession)
    names = [f.split(" ", 1)[0] for f in fields.split(", ")]

    def run(batches):
        try:
            for b in batches:
                # a batch of long texts is answered some rows at a time
                for low in range(0, b.num_rows, 256):
                    part = b.slice(low, 256)
                    rows = [row(v.as_py()) for v in part.column(1)]
                    cols = [pa.array(list(c)) if rows else pa.array([]) for c in zip(*rows)]
                    yield pa.RecordBatch.from_arrays([part.column(0), *cols], names=["id", *names])
        finally:
            for tables in held():
                tables.rest()

    of = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{col}`").cast(kind).alias("value"))
    out = of.mapInArrow(run, f"id {of.schema['id'].dataType.simpleString()}, {fields}")
    return out.withColumnRenamed("id", id_col)


def encode_documents(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>): every whole text's token ids (null: none)."""

    def row(text):
        return ([int(i) for ids in encode_stream(path, text or "") for i in ids],)

    return _mapped(df, id_col, text_col, "string", "ids array<bigint>", row, lambda: [encoded_words(path), codec(path)])


def decode_documents(df: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids", joined: bool = True) -> DataFrame:
    """(id, text): ``joined`` gives token strings joined by a space, as the
    library decodes a file that names no decoder; else plain text."""

    def row(ids):
        of = codec(path)
        return ("".join(of.pieces([ids or []]) if joined else of.text(ids or [])),)

    return _mapped(df, id_col, ids_col, "array<bigint>", "text string", row)


def round_trip(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256): digests of every text's ids
    (decimal, joined by one space) and of what they decode to, computed as the
    tokens come, so no text's ids are held whole."""

    def row(text):
        of, n = codec(path), 0
        ids_hash, text_hash, glue = hashlib.sha256(), hashlib.sha256(), ""

        def chunks():
            nonlocal n, glue
            for ids in encode_stream(path, text or ""):
                if len(ids):
                    ids = ids.tolist()
                    ids_hash.update((glue + " ".join(map(of.decimals.__getitem__, ids))).encode())
                    n, glue = n + len(ids), " "
                    yield ids

        for piece in of.pieces(chunks()):
            text_hash.update(piece.encode())
        return n, ids_hash.hexdigest(), text_hash.hexdigest()

    fields = "n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    return _mapped(df, id_col, text_col, "string", fields, row, lambda: [encoded_words(path), codec(path)])
