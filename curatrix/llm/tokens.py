"""Encoding whole texts with the ``tokenizers`` library, remembering the ids of pieces seen before.

A text is cut only where the tokenizer's own pre-tokenizer always cuts: before a run of blanks that
follows a non-blank. Pieces are therefore encoded independently, and their ids joined are those of the
whole text. Texts with rarer white space, about which Python and the tokenizer may disagree, are
encoded whole.
"""

from __future__ import annotations

import os
import re
from contextlib import suppress
from itertools import chain

import numpy as np

_ODD_SPACE = re.compile(r"[\x00\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u2000-\u200b\u2028\u2029\u202f\u205f\u3000\ufeff]")
_PIECE = re.compile(r"[ \n\r\t]*[^ \n\r\t]+|[ \n\r\t]+")
_MARK = "\x01"
_START = "\x00"
_BLANKS = " \n\r\t"
#: Pieces that a Python worker remembers (about 110 MB); later ones are encoded each time, until they are so many that it starts anew.
REMEMBERED = 600_000

_open: dict[str, "Encoder"] = {}


def encoder(path: str) -> "Encoder":
    """The process-wide encoder of a tokenizer file: its memory serves all tasks of a Python worker."""
    if path not in _open:
        _open[path] = Encoder(path)
    return _open[path]


class Encoder:
    def __init__(self, path: str, remembered: int = REMEMBERED):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.remembered = remembered
        self.known: dict[str, bytes] = {}
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        self.dtype = np.dtype("<u2" if self.width == 2 else "<u4")
        pre, normal = str(self.tokenizer.pre_tokenizer), str(self.tokenizer.normalizer)
        # Byte-level pre-tokenizing keeps blanks with the next word; the other kind drops them.
        self.keeps_blanks = pre.startswith("ByteLevel(") and normal == "None"
        self.drops_blanks = "behavior=Removed, invert=True" in pre and "\\s+" in normal
        mark = self._plain(["a " + _MARK])[0]
        self.mark = int(mark[-1]) if len(mark) == 2 else None
        if self.keeps_blanks:
            self.n_bytes = np.zeros(self.tokenizer.get_vocab_size(), np.int64)
            for token, i in self.tokenizer.get_vocab().items():
                self.n_bytes[i] = len(token)  # each character of a token stands for one byte

    def _plain(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, self.dtype) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _cut(self, text: str) -> list[str]:
        """A text's pieces as keys: ``w`` stands for a blank and w, ``\\x00w`` for w at the start of a text, others for themselves."""
        if self.drops_blanks:
            return text.split()
        if not text:
            return []
        if "  " in text or " \n" in text or "\n " in text or "\n\n" in text or "\t" in text or "\r" in text or text[-1] in _BLANKS or text[0] in _BLANKS:
            pieces = [p[1:] if p[0] == " " and p[1:2] not in (*_BLANKS, "") else p for p in _PIECE.findall(text)]
            if text[0] not in _BLANKS:
                pieces[0] = _START + pieces[0]
            return pieces
        return (_START + text.replace("\n", " \n")).split(" ")

    def _learn(self, keys: list[str]) -> dict[str, bytes]:
        """Ids of pieces that aren't remembered, encoded in one text where the seams are certain."""
        learnt: dict[str, bytes] = {}
        if self.keeps_blanks:
            pieces = [k[1:] if k[0] == _START else k if k[0] in _BLANKS else " " + k for k in keys]
            joined = [p for p in pieces if p[0] in _BLANKS and p[-1] not in _BLANKS and "<|" not in p]
        elif self.mark is not None:
            pieces = keys
            joined = [p for p in pieces if _MARK not in p and "<|" not in p and p.strip(_BLANKS)]
        else:
            pieces, joined = keys, []
        alone, key_of = pieces, dict(zip(pieces, keys))
        if joined:
            many = set(joined)
            alone = [p for p in pieces if p not in many]
            if self.keeps_blanks:
                ids = self._plain(["".join(joined)])[0]
                ends = np.cumsum([len(p.encode()) for p in joined])
                cuts = np.searchsorted(np.cumsum(self.n_bytes[ids]), ends) + 1
                firsts = np.concatenate([[0], cuts[:-1]])
            else:
                ids = self._plain([f" {_MARK} ".join(joined) + f" {_MARK}"])[0]
                cuts = np.flatnonzero(ids == self.mark)
                firsts = np.concatenate([[0], cuts[:-1] + 1])
            assert len(cuts) == len(joined)
            raw, w = ids.tobytes(), self.width
            for p, a, b in zip(joined, (firsts * w).tolist(), (cuts * w).tolist()):
                learnt[key_of[p]] = raw[a:b]
        for p, ids in zip(alone, self._plain(alone)):
            learnt[key_of[p]] = ids.tobytes()
        return learnt

    def encode(self, texts: list[str]) -> list[bytes]:
        """Each text's ids as little-endian words of ``self.width`` bytes."""
        if not (self.keeps_blanks or self.drops_blanks):
            return [x.tobytes() for x in self._plain(texts)]
        cut = self._cut
        # Printable texts have no white space but blanks, which is quicker to tell.
        odd = {i for i, t in enumerate(texts) if not t.replace("\n", " ").isprintable() and _ODD_SPACE.search(t)}
        pieces = [[] if i in odd else cut(t) for i, t in enumerate(texts)]
        known = self.known
        flat = list(chain.from_iterable(pieces))
        found = list(map(known.get, flat))
        places, at = [], -1
        with suppress(ValueError):  # raised by index() after the last one
            while True:
                places.append(at := found.index(None, at + 1))
        if places:
            learnt = self._learn(list({flat[i] for i in places}))
            for i in places:
                found[i] = learnt[flat[i]]
            if 4 * len(places) > len(flat) and len(known) >= self.remembered:
                known.clear()
            if len(known) < self.remembered:
                known.update(learnt)
        out, at = [], 0
        for ps in pieces:
            out.append(b"".join(found[at : at + len(ps)]))
            at += len(ps)
        if odd:
            whole = sorted(odd)
            for i, ids in zip(whole, self._plain([texts[i] for i in whole])):
                out[i] = ids.tobytes()
        return out
