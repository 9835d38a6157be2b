"""SentencePiece encoding and decoding by a shared-prefix forward pass over the distinct marked words."""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held, pieces, texts

MARK = "▁"
_CUT = re.compile(f"(?<=[^{MARK}])(?={MARK})")
#: The state before a word's first letter; above all ids of pieces and letters.
_NONE = 1 << 21


def fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of each field of a protocol-buffer message."""

    def number(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            value |= (raw[at] & 127) << shift
            shift, at = shift + 7, at + 1
            if raw[at - 1] < 128:
                return value, at

    at = 0
    while at < len(raw):
        key, at = number(at)
        if key & 7 == 0:
            value, at = number(at)
        else:
            size, at = number(at) if key & 7 == 2 else ({1: 8, 5: 4}[key & 7], at)
            value, at = raw[at : at + size], at + size
        yield key >> 3, value


#: Fixed values of the model format: the fields of pieces and of the trainer's settings, the type of a piece, the kind of a model.
_PIECES, _TRAINER, _PIECE_TYPE, _MODEL_TYPE, _USER_DEFINED, _UNIGRAM, _BPE = 1, 2, 3, 3, 4, 1, 2


def kind_of(path: str) -> int:
    """Whether the model is _UNIGRAM or _BPE; others, and models with user-defined pieces, can't be encoded word by word."""
    with open(path, "rb") as f:
        message = list(fields(f.read()))
    kind = next((v for n, part in message if n == _TRAINER for m, v in fields(part) if m == _MODEL_TYPE), _UNIGRAM)
    if kind not in (_UNIGRAM, _BPE) or any(v == _USER_DEFINED for n, part in message if n == _PIECES for m, v in fields(part) if m == _PIECE_TYPE):
        raise ValueError("only unigram and BPE models without user-defined pieces can be encoded")
    return kind


def raw_pieces(model) -> list[bytes]:  # noqa: ANN001
    """The bytes that each id stands for."""
    out = []
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        if model.is_byte(i):
            out.append(bytes([int(piece[1:-1], 16)]))
        else:
            out.append(b"" if model.is_control(i) or model.is_unknown(i) or model.is_unused(i) else piece.replace(MARK, " ").encode())
    return out


class Pieces:
    """The pieces of a BPE model with byte fallback, and their ids per word.

    In a BPE model scores order merges and are no log-probabilities, so the path of the
    largest sum is not the library's segmentation.  The forward pass therefore keeps, instead of a best
    sum, the one piece that the encoding of each prefix ends with.  A piece ends a prefix exactly if it
    and the last piece of what precedes it stay apart when both are merged afresh; one piece does, and
    pieces that pairwise stay apart are the encoding.  Like a Viterbi state this depends on the prefix
    alone, so words that share a prefix share it.  ``Unigram`` has the sums.
    """

    def __init__(self, path: str, cache: int = 100_000):
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        self.rank: dict[str, tuple[float, int]] = {}
        self.byte, self.names, self.unknown = [0] * 256, [model.id_to_piece(i) for i in range(n)], model.unk_id()
        self.bytes = False
        for i, piece in enumerate(self.names):
            if model.is_byte(i):
                self.byte[int(piece[1:-1], 16)] = i
                self.bytes = True
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                if MARK in piece.lstrip(MARK):
                    raise ValueError(f"piece {piece!r} reaches over a word's mark; words can't be encoded alone")
                self.rank[piece] = (model.get_score(i), i)
        if not self.bytes and MARK not in self.rank:
            raise ValueError("unknown letters would run over the marks of words; words can't be encoded alone")
        #: Pieces by their letters from the last to the first; "" leads to a piece's id.
        self.ends: dict = {}
        for piece, (_, i) in self.rank.items():
            node = self.ends
            for letter in reversed(piece):
                node = node.setdefault(letter, {})
            node[""] = i
        self.apart: dict[int, bool] = {}
        self.halves: dict[str, tuple[str, str]] = {}
        self.limit, self.known = cache, {}

    @classmethod
    def load(cls, path: str) -> Pieces:
        return held(("pieces", path), lambda: (Unigram if kind_of(path) == _UNIGRAM else Pieces)(path))

    def spelled(self, last: list[int], starts: list[int], word: str) -> bytes:
        """Ids along the path that ends with the word; a letter without a piece is its bytes, or unknown, a run of them once."""
        base, ids, i = len(self.names), [], len(word)
        while i:
            piece, i = last[i], starts[i]
            if piece < base:
                ids.append(piece)
            elif self.bytes:
                ids.extend(self.byte[b] for b in reversed(chr(piece - base).encode()))
            elif not ids or ids[-1] != self.unknown:
                ids.append(self.unknown)
        ids.reverse()
        return array("i", ids).tobytes()

    def merged(self, text: str, until: int = 1) -> list[str]:
        """``text`` merged from single letters to ``until`` parts at least: the best-scored pair first, the leftmost of equal ones."""
        parts = list(text)
        while len(parts) > until:
            best = max(((self.rank[x][0], -i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if (x := a + b) in self.rank), default=None)
            if best is None:
                break
            i = -best[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def split(self, piece: str) -> tuple[str, str]:
        """The two parts whose merge made ``piece`` last; ("", piece) for a letter."""
        known = self.halves.get(piece)
        if known is None:
            parts = self.merged(piece, until=2)
            known = self.halves[piece] = (parts[0], parts[1]) if len(parts) == 2 else ("", piece)
        return known

    def stay_apart(self, a: str, b: str) -> bool:
        """Whether merging a + b afresh gives [a, b].

        Merges run in order of rank, so what touches the border between a and b at some time are parts of
        both.  Going back in time, the part made last is split again; a and b don't stay apart if two parts
        that met at the border had a merge that came before the next one of either.
        """
        if not a:
            return self.merged(b) == [b]
        rank, limit = self.rank, (float("inf"), 0)
        made = lambda x: -rank[x][0] if len(x) > 1 else -1.0
        while True:
            if (x := a + b) in rank and (-rank[x][0], 0) < limit:
                return False
            if len(a) == 1 and len(b) == 1:
                return True
            if made(a) > made(b):
                limit, a = (made(a), 0), self.split(a)[1]
            else:
                limit, b = (made(b), 1), self.split(b)[0]

    def learn(self, words: Iterable[str]) -> None:
        """Encode distinct marked words in sorted order: the walk of their trie, depth first.

        ``last[i]`` is the last piece of the encoding of the path's first i letters and ``starts[i]`` where it
        begins; going to the next word keeps the entries of the prefix that both share.
        """
        apart, ends, names = self.apart, self.ends, self.names
        base, known = len(names), self.known
        if len(apart) > 300_000:
            apart.clear()
        last, starts, path = [_NONE], [0], ""
        for word in sorted(words):
            shared, most = 0, min(len(path), len(word))
            while shared < most and path[shared] == word[shared]:
                shared += 1
            del last[shared + 1 :], starts[shared + 1 :]
            for i in range(shared, len(word)):
                node, at = ends, i + 1
                while at:
                    at -= 1
                    node = node.get(word[at])
                    if node is None:
                        at, piece = i, base + ord(word[i])  # a letter that no piece has
                        break
                    piece = node.get("")
                    if piece is not None:
                        pair = last[at] << 22 | piece
                        fits = apart.get(pair)
                        if fits is None:
                            before = last[at]
                            a = "" if before == _NONE else names[before] if before < base else chr(before - base)
                            fits = apart[pair] = self.stay_apart(a, names[piece])
                        if fits:
                            break
                else:
                    at, piece = i, base + ord(word[i])
                last.append(piece)
                starts.append(at)
            path = word
            known[word] = self.spelled(last, starts, word)

    def words(self, text: str) -> list[str]:
        """Marked words; only the first mark of each is left away, as all of them have it."""
        if not text:
            return []
        if "  " in text or text[0] == " " or MARK in text:
            return [w[1:] for w in _CUT.split(MARK + text.replace(" ", MARK))]
        return text.split(" ")

    def encode(self, batch: list[str]) -> list[bytes]:
        """Ids as signed 32-bit bytes; new words of the whole batch are learned together."""
        if len(self.known) > self.limit:
            self.known.clear()
        known, split = self.known, [self.words(t) for t in batch]
        new = {MARK + w for ws in split for w in ws if MARK + w not in known}
        self.learn(new)
        return [b"".join([known[MARK + w] for w in ws]) for ws in split]


class Unigram(Pieces):
    """A unigram model: scores are log-probabilities, and the encoding is the path of the largest sum (Viterbi).

    Of equal sums the path whose last piece begins first is taken; sums have single precision and a letter
    without a piece costs 10 more than the worst piece, as in the library.  There a sum runs over the whole text;
    here it begins anew with each word, which can only differ where two paths are equal up to rounding.
    """

    def learn(self, words: Iterable[str]) -> None:
        """The same walk as in BPE; the state of a prefix is its best sum and the last piece on the way to it."""
        ends, names, base = self.ends, self.names, len(self.names)
        score = {i: np.float32(s) for s, i in self.rank.values()}
        worst = min(score.values(), default=np.float32(0)) - np.float32(10)
        last, starts, best, path = [_NONE], [0], [np.float32(0)], ""
        for word in sorted(words):
            shared, most = 0, min(len(path), len(word))
            while shared < most and path[shared] == word[shared]:
                shared += 1
            for state in (last, starts, best):
                del state[shared + 1 :]
            for i in range(shared, len(word)):
                node, at = ends, i + 1
                top, piece, start = best[i] + worst, base + ord(word[i]), i
                while at:
                    at -= 1
                    node = node.get(word[at])
                    if node is None:
                        break
                    found = node.get("")
                    # A letter that is a piece itself is never unknown.
                    if found is not None and ((total := best[at] + score[found]) >= top or at == i):
                        top, piece, start = total, found, at
                last.append(piece)
                starts.append(start)
                best.append(top)
            path = word
            self.known[word] = self.spelled(last, starts, word)


_ENCODED = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("ids", pa.list_(pa.int32())), ("ids_crc32", pa.int64())])
#: Texts whose new words are learned together, and that stand in memory at a time.
ROWS = 512


def encode(docs: DataFrame, model: str) -> DataFrame:
    """(doc_id, text, ids array<int>, ids_crc32): the ids of each whole text under a SentencePiece model.

    BPE and unigram models are encoded alike.  ``ids_crc32`` covers the ids as little-endian 32-bit integers.
    Words are learned per ROWS texts and kept in a bounded cache of the worker, so nothing is shuffled and no
    state grows with the table.  Null and empty texts have no ids; repeated rows and null doc_id are kept as
    they are.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Pieces.load(model)
        for batch in pieces(batches, ROWS):
            found = table.encode(batch.column("text").to_pylist())
            at = np.concatenate([[0], np.cumsum([len(x) // 4 for x in found])]).astype(np.int32)
            ids = pa.Array.from_buffers(pa.int32(), int(at[-1]), [None, pa.py_buffer(b"".join(found))])
            columns = [batch.column("doc_id"), batch.column("text"), pa.ListArray.from_arrays(pa.array(at), ids), pa.array([zlib.crc32(x) for x in found], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, schema=_ENCODED)

    return texts(docs, F.col("doc_id").cast("long").alias("doc_id")).mapInArrow(run, "doc_id long, text string, ids array<int>, ids_crc32 long")


def decode(encoded: DataFrame, model: str) -> DataFrame:
    """Adds ``decoded``: the text of ``ids``; a null list is null, broken characters are U+FFFD.  All other columns stay.

    The bytes of the pieces stand in the plan (one string of the vocabulary's size), so decoding is an
    expression and needs no second worker.
    """
    from sentencepiece import SentencePieceProcessor

    table = F.split(F.lit(",".join(x.hex() for x in raw_pieces(SentencePieceProcessor(model_file=model)))), ",")
    whole = F.array_join(F.transform("ids", lambda i: F.element_at(table, i + 1)), "")
    text = F.call_function("make_valid_utf8", F.unhex(whole).cast("string"))
    return encoded.withColumn("decoded", F.when(F.startswith(text, F.lit(" ")), F.substr(text, F.lit(2))).otherwise(text))
