"""Token ids of whole texts with the tokenizers library, exactly as one call for each text gives them, but faster.

A text is cut where a tokenizer's own rules always cut: before a single blank or line feed between two characters that
aren't white space (byte-level rule), or at any white space (word rule, which drops it). A piece is cut again before the
marks that end it, if a letter or digit is before them. Ids of pieces are kept in a bounded table of each worker, so a piece
is encoded once and texts are joined from byte strings. A text in which those cuts would not be certain, or that could
hold a special token, is encoded whole; so special tokens in a text are what the library makes of them.
"""

from __future__ import annotations

import os
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from assay.llm.common import worker_cache

#: Pieces that a worker keeps in each of two generations, and their longest.
KEPT, LONGEST = 400_000, 32
#: Characters that are cut at once.
AT_ONCE = 4_000_000

#: White space other than blanks and line feeds, and what could be taken for it.
RARE_SPACE = "\x01\t\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0                　"
#: What str.split takes for white space and the tokenizer doesn't, or the other way round.
UNSURE_SPACE = "\x01\x1c\x1d\x1e\x1f᠎​﻿"

#: A full stop or comma after a letter or digit begins a word of its own. (Of letters, those all Unicode versions know.)
BEFORE_MARK = "([0-9A-Za-zÀ-ÖØ-öø-ÿ])([.,])"
#: The signs that stand for bytes in a byte-level vocabulary: printing ones for themselves, the others from U+0100 on.
_OWN = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
BYTE_SIGNS = dict(zip([b for b in range(256) if b not in _OWN], range(256, 512), strict=False))


class Encoder:
    """specials_as_text: strings of special tokens in a text are ordinary text (the library's default is that they are the
    tokens)."""

    def __init__(self, path: str, rule: str, specials_as_text: bool = False):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = specials_as_text
        self.specials = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.rule, self.kept, self.older = rule, {}, {}

    def whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(x.ids, dtype="<u4").tobytes() for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def is_sure(self, text: str) -> bool:
        """Whether a text can be cut into pieces."""
        if any(s in text for s in self.specials):
            return False
        if self.rule == "words":
            return not any(c in text for c in UNSURE_SPACE)
        return not (text[:1] in (" ", "\n", "") or text[-1] in " \n" or "  " in text or "\n\n" in text or " \n" in text or "\n " in text or any(c in text for c in RARE_SPACE))

    def pieces(self, texts: list[str]) -> pa.Array:
        """A list for each text. A piece from a line feed or \1 on has no blank before it; the others do."""
        if self.rule == "words":
            return pc.utf8_split_whitespace(pc.replace_substring_regex(pa.array(texts, pa.large_string()), BEFORE_MARK, r"\1 \2"))
        column = pc.replace_substring_regex(pa.array([f"\1{t}" for t in texts], pa.large_string()), BEFORE_MARK, "\\1 \1\\2")
        return pc.split_pattern(pc.replace_substring(column, "\n", " \n"), " ")

    def source(self, piece: str) -> str:
        if self.rule == "words" or piece[0] == "\n":
            return piece
        return piece[1:] if piece[0] == "\1" else f" {piece}"

    def word(self, piece: str) -> str | None:
        """What the model calls a piece of letters alone, which is one word for it; None if the library must see to it."""
        if self.rule == "words":
            if not piece.isalpha() or not piece.isascii() and max(piece) > "\xff":  # small letters and normal forms are the library's
                return None
            low = piece.lower()
            return low if low.isascii() else low.encode().decode("latin-1").translate(BYTE_SIGNS)
        if piece[0] == "\1":
            piece, blank = piece[1:], ""
        else:
            blank = "Ġ"
        if not piece.isalpha():
            return None
        return blank + (piece if piece.isascii() else piece.encode().decode("latin-1").translate(BYTE_SIGNS))

    def learn(self, pieces: list[str]) -> dict[str, bytes]:
        """The ids of pieces that aren't in the table; short ones are put there."""
        known: dict[str, bytes] = {}
        older, tokenize, word, rest = self.older.get, self.tokenizer.model.tokenize, self.word, []
        for piece in pieces:
            if (ids := older(piece) if piece else b"") is not None:
                known[piece] = ids
            elif (own := word(piece)) is not None:
                known[piece] = array("I", [x.id for x in tokenize(own)]).tobytes()
            else:
                rest.append(piece)
        known.update(zip(rest, self.whole([self.source(p) for p in rest]), strict=True))
        if len(self.kept) + len(known) > KEPT:
            self.older, self.kept = self.kept, {}
        self.kept.update(known if max(map(len, known), default=0) <= LONGEST else {p: ids for p, ids in known.items() if len(p) <= LONGEST})
        return known

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, as little-endian unsigned 32-bit integers. Equal texts are encoded once."""
        out: dict[str, bytes] = dict.fromkeys(texts)
        sure = [t for t in out if self.is_sure(t)]
        chunk, n = [], 0
        for text in sure:
            chunk.append(text)
            n += len(text)
            if n >= AT_ONCE:
                out.update(zip(chunk, self.from_pieces(chunk), strict=True))
                chunk, n = [], 0
        if chunk:
            out.update(zip(chunk, self.from_pieces(chunk), strict=True))
        uncut = [t for t, ids in out.items() if ids is None]
        out.update(zip(uncut, self.whole(uncut), strict=True))
        return [out[t] for t in texts]

    def from_pieces(self, texts: list[str]) -> list[bytes]:
        """Each different piece is looked up once; the ids of all texts are gathered from theirs in one step."""
        lists = self.pieces(texts)
        held = lists.flatten().dictionary_encode()
        pieces, which = held.dictionary.to_numpy(zero_copy_only=False).tolist(), held.indices.to_numpy()
        ids = list(map(self.kept.get, pieces))
        missing = [i for i, x in enumerate(ids) if x is None]
        new = self.learn([pieces[i] for i in missing])
        for i in missing:
            ids[i] = new[pieces[i]]
        lengths = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        flat, starts = np.frombuffer(b"".join(ids), "<u4"), np.cumsum(lengths) - lengths
        many = lengths[which]
        ends = np.cumsum(many)
        flat = flat[np.repeat(starts[which] - ends + many, many) + np.arange(int(ends[-1]) if len(ends) else 0)]
        bounds = np.append(0, ends)[lists.offsets.to_numpy()].tolist()
        return [flat[a:b].tobytes() for a, b in zip(bounds, bounds[1:], strict=False)]


def encoder(path: str, rule: str, specials_as_text: bool = False) -> Encoder:
    """rule: "bytes" for a byte-level BPE whose white space goes with the next word, "words" for one that drops it."""
    return worker_cache("tokens", (path, rule, specials_as_text), lambda: Encoder(path, rule, specials_as_text))


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
