"""Token ids of whole texts by a public tokenizer, as little-endian unsigned 16-bit bytes.

Texts are cut at single spaces between two characters that are not white space, and there, where a stretch holds nothing
but letters, marks and single line ends, also between these. Both vocabularies here start a new token at each such place,
so the pieces' ids, one after another, are the ids of the whole text. All texts of a batch are cut at once, on their bytes;
each different piece of a batch is looked up once. A worker keeps what it has seen for the batches and tasks that follow:
two generations of at most `keep` pieces of at most LONGEST characters. A full one becomes the older, whose pieces come
back when they are met again.
"""

from __future__ import annotations

import os
import re
from array import array

import numpy as np
import pyarrow as pa

WORD_BPE = "word_bpe_49k.json"
BYTE_BPE = "byte_bpe_50k.json"
LONGEST = 64
#: Bytes of text that are cut at once, or one text.
CHUNK = 1 << 22

#: Letters that normalization leaves alone (but for case), and marks without the apostrophe.
LETTERS, MARKS = "A-Za-zÀ-ÖØ-öø-ÿ", r"!-&(-/:-@\[-`{-~"
PLAIN = re.compile(f" ?[{LETTERS}]+")

ODD, LETTER, MARK, LINE, SPACE = range(5)
KIND = np.array([SPACE if c == " " else LINE if c == "\n" else LETTER if re.match("[A-Za-z]", c) else MARK if re.match(f"[{MARKS}]", c) else ODD for c in map(chr, range(256))], np.uint8)
#: Second bytes of letters whose first byte is C3.
SECOND = np.array([128 <= i < 192 and PLAIN.match(chr(i + 64)) is not None for i in range(256)])
#: Bytes that may begin or end white space: between one of these and a space nothing is cut.
LEAD = np.isin(np.arange(256), (0xC2, 0xE1, 0xE2, 0xE3))
GAP = LEAD | (np.arange(256) <= 32) | (np.arange(256) == 127)


def cuts(raw: np.ndarray, texts: np.ndarray, bare: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and the first one of each piece, for texts one after another that begin at the given bytes (and the end); bare: with spaces as pieces of their own and, where a stretch is cut into words, in lower case."""
    if not len(raw):
        return raw, np.zeros(0, np.int64)
    begins = texts[:-1][np.diff(texts) > 0]
    kind = KIND[raw]
    wide = np.flatnonzero((raw[:-1] == 0xC3) & SECOND[raw[1:]])
    kind[wide] = kind[wide + 1] = LETTER
    spaces = np.flatnonzero(kind == SPACE)
    edge = np.zeros(len(raw) + 1, bool)
    edge[begins] = edge[-1] = True
    # bytes 2 and 3 before a space tell whether what ends there may be white space of several bytes
    loose = edge[spaces] | edge[spaces + 1] | GAP[raw[spaces - 1]] | GAP[raw[np.minimum(spaces + 1, len(raw) - 1)]]
    loose |= (raw[spaces - 1] >= 128) & (LEAD[raw[np.maximum(spaces - 2, 0)]] | LEAD[raw[np.maximum(spaces - 3, 0)]])
    whole = kind == ODD
    whole[spaces[loose]] = True
    whole[:-1] |= ((kind[:-1] == LINE) & (kind[1:] == LINE)) | ((raw[:-1] == ord("<")) & (raw[1:] == ord("|")))
    edge = edge[:-1]
    edge[spaces[~loose]] = True
    if bare:
        edge[spaces[~loose] + 1] = True
    stretches = np.flatnonzero(edge)
    inner = np.repeat(~np.logical_or.reduceat(whole, stretches), np.diff(stretches, append=len(raw)))
    if bare:
        upper = (raw >= 65) & (raw <= 90)
        upper[wide + 1] = raw[wide + 1] < 0x9F
        raw = raw + 32 * (upper & inner).view(np.uint8)
    inner[1:] &= (kind[1:] != kind[:-1]) & (kind[:-1] != SPACE)
    return raw, np.flatnonzero(edge | inner)


class Known(dict):
    """Ids of the pieces seen so far, as bytes; a new piece is encoded when it is first asked for."""

    def __init__(self, tokenizer, keep: int):
        from tokenizers.pre_tokenizers import ByteLevel

        super().__init__()
        self.older: dict[str, bytes] = {}
        alone = ByteLevel(add_prefix_space=False, use_regex=False)
        self.letters = {i: alone.pre_tokenize_str(chr(i))[0][0] for i in range(32, 256) if i == 32 or PLAIN.fullmatch(chr(i))}
        self.tokenizer, self.tokenize, self.keep, self.spaced = tokenizer, tokenizer.model.tokenize, keep, tokenizer.normalizer is None

    def __missing__(self, piece: str) -> bytes:
        if (ids := self.older.pop(piece, None)) is None:
            word = piece[1:] if piece[:1] == " " else piece
            if plain := word.isascii() and word.isalpha():
                word = self.letters[32] + word if word is not piece else word
            elif plain := PLAIN.fullmatch(piece):
                word = piece.translate(self.letters)
            if not self.spaced and (piece[:1] == " " or piece.lower() != piece):
                plain = False
            # the model alone for words: the steps before it only change spelling of bytes here
            found = [t.id for t in self.tokenize(word)] if plain else self.tokenizer.encode(piece, add_special_tokens=False).ids
            ids = array("H", found).tobytes()
        if len(piece) <= LONGEST:
            if len(self) >= self.keep:
                self.older = dict(self)
                self.clear()
            self[piece] = ids
        return ids


class Encoder:
    def __init__(self, name: str, keep: int = 500_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import public_tokenizers
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(name if "/" in name else public_tokenizers.path(name))
        self.known = Known(self.tokenizer, keep)

    def _chunk(self, raw: np.ndarray, texts: np.ndarray) -> list[bytes]:
        raw, at = cuts(raw, texts, not self.known.spaced)
        pieces = pa.Array.from_buffers(pa.large_string(), len(at), [None, pa.py_buffer(np.append(at, len(raw))), pa.py_buffer(raw)]).dictionary_encode()
        found = [self.known[p] for p in pieces.dictionary.to_numpy(zero_copy_only=False).tolist()]
        which = pieces.indices.to_numpy()
        counts = np.fromiter(map(len, found), np.int64, len(found)) // 2
        first = np.cumsum(counts) - counts
        counts = counts[which]
        ends = np.append(0, np.cumsum(counts))
        ids = np.frombuffer(b"".join(found), "<u2")[np.repeat(first[which] - ends[:-1], counts) + np.arange(ends[-1])].tobytes()
        own = (2 * ends[np.searchsorted(at, texts)]).tolist()
        return [ids[a:b] for a, b in zip(own[:-1], own[1:], strict=True)]

    def encode_all(self, texts: pa.Array) -> list[bytes]:
        """The ids of each text; null is empty."""
        texts = texts.cast(pa.large_string()).fill_null("")
        _, places, data = texts.buffers()
        places = np.frombuffer(places, np.int64)[texts.offset :][: len(texts) + 1]
        raw = np.frombuffer(data or b"", np.uint8)
        out, i = [], 0
        while i < len(texts):
            j = max(i + 1, int(np.searchsorted(places, places[i] + CHUNK, "right")) - 1)
            out += self._chunk(raw[places[i] : places[j]], places[i : j + 1] - places[i])
            i = j
        return out

    def encode(self, text: str) -> bytes:
        """The ids of one text."""
        return self.encode_all(pa.array([text], pa.large_string()))[0]


_encoders: dict[str, Encoder] = {}


def encoder(name: str) -> Encoder:
    """This worker's encoder."""
    if name not in _encoders:
        _encoders[name] = Encoder(name)
    return _encoders[name]
