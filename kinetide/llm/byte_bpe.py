"""Ids of a byte-level BPE tokenizer file, with a bounded cache of words."""

from __future__ import annotations

import json
import re
from array import array

from .common import held

#: A blank that another character than white space follows always starts a pre-token of its own.
_CUT = re.compile(r"(?= \S)")
_ODD = re.compile(r" (?:\s|$)")
#: The split pattern of byte-level BPE vocabularies of this family.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in such vocabularies: printable bytes for themselves, the rest from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteBpe:
    """``encode`` gives the ids of a text as unsigned 32-bit bytes in the machine's order (little-endian wherever Spark runs).

    The ids are those of ``tokenizers`` for the same file.  With ``special`` the strings of added tokens are
    their ids, as ``tokenizers`` has it unless told otherwise; without, those of special tokens are ordinary
    text.  Where the file's merges are in the order of their ids (as here), ``tiktoken`` runs the same
    merges several times faster; otherwise ``tokenizers`` itself is used.  Words repeat, so their ids are
    kept; the cache is emptied when it holds ``cache`` words.
    """

    def __init__(self, path: str, cache: int = 150_000, special: bool = False):
        self.limit, self.known, self.added, self.ids = cache, {}, None, {}
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, letters = spec["model"]["vocab"], _byte_letters()
        added = {t["content"] for t in spec["added_tokens"]}
        ranks = {bytes(letters[c] for c in t): i for t, i in vocab.items() if t not in added}
        merged = [vocab["".join(m if isinstance(m, list) else m.split(" "))] for m in spec["model"]["merges"]]
        pre = spec["pre_tokenizer"]
        plain = merged == sorted(merged) and spec["normalizer"] is None and pre["type"] == "ByteLevel" and not pre["add_prefix_space"]
        if special and any(t[k] for t in spec["added_tokens"] for k in ("single_word", "lstrip", "rstrip")):
            plain = False
        if plain:
            import tiktoken

            if special and added:
                self.added = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")")
                self.ids = {t["content"]: array("I", [t["id"]]).tobytes() for t in spec["added_tokens"]}
            self._words = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        else:
            from tokenizers import Tokenizer

            whole = Tokenizer.from_file(path)
            whole.encode_special_tokens = not special
            self._words = lambda s: whole.encode(s, add_special_tokens=False).ids
            self.limit = 0

    @classmethod
    def load(cls, path: str, special: bool = False) -> ByteBpe:
        """One per worker and file, so that words are shared by its tasks."""
        return held(("byte BPE", path, special), lambda: cls(path, special=special))

    def encode(self, text: str) -> bytes:
        if self.added is None:
            return self._plain(text)
        return b"".join(self.ids[x] if i % 2 else self._plain(x) for i, x in enumerate(self.added.split(text)))

    def _plain(self, text: str) -> bytes:
        if not text:
            return b""
        if not self.limit or len(text) < 2:
            return array("I", self._words(text)).tobytes()
        if _ODD.search(text):
            first, *rest = _CUT.split(text)
            rest = [w[1:] for w in rest]
        else:
            first, *rest = text.split(" ")
        known, words = self.known, self._words
        if len(known) > self.limit:
            known.clear()
        out = [array("I", words(first)).tobytes()]
        for w in rest:
            ids = known.get(w)
            if ids is None:
                ids = known[w] = array("I", words(" " + w)).tobytes()
            out.append(ids)
        return b"".join(out)
