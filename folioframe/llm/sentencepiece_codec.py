"""SentencePiece BPE encoding by backtracking, and decoding.

A sequence of pieces is the encoding of a text if and only if every two neighbours
are compatible: merging the characters of both again must give the same two pieces.
So the encoder takes the longest piece at each place (one Aho-Corasick pass finds
them), shortens it while it is incompatible with the piece before, and steps back
where nothing fits; a bitfield remembers places from which no way leads on (a byte for each
place, so that clearing one costs the same however long the text).

A word mark only ever starts a piece, or stands in a run of marks, so a text falls
into parts (marks and a word; a line feed, which no piece contains) that merge
independently.  Parts are encoded once and remembered, up to a fixed number.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable

import ahocorasick
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from .common import append_columns

MARK = "▁"
LETTER = "[A-Za-zÀ-ÖØ-öø-ÿ]"
#: Parts remembered by one Python worker; beyond it the memory is emptied, which changes no result.
REMEMBERED = 300_000
#: Pairs of pieces whose compatibility is remembered, likewise.
PAIRS = 300_000
#: Texts that a normalizer, another prefix rule or user-defined pieces would encode otherwise.
PROBES = ("", " a", "a  b ", "\t\n", "ﬁ Ａ １ ² Å e\u0301", "\u00a0x\u3000y\u200b", "A B", "<s> </s> <unk> <pad> <0x41> <mask> <sep> <cls>", "▁▁a")


class PieceCodec:
    """Encodes and decodes as the library does with its identity normalizer and byte fallback."""

    def __init__(self, model_path: str):
        model = sentencepiece.SentencePieceProcessor(model_file=model_path)
        size = model.vocab_size()
        self.end_id = model.eos_id()
        pieces = [model.id_to_piece(i) for i in range(size)]
        self.byte_ids = {int(pieces[i][3:5], 16): i for i in range(size) if model.is_byte(i)}
        self.id_bytes = {i: b for b, i in self.byte_ids.items()}
        special = {i for i in range(size) if model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i)}
        ordered = sorted((i for i in range(size) if i not in special), key=lambda i: (-model.get_score(i), i))
        self.rank = {pieces[i]: r for r, i in enumerate(ordered)}
        self.id_of = {pieces[i]: i for i in ordered}
        self.surface = {i: p.replace(MARK, " ") for p, i in self.id_of.items()}
        self.decimal = [str(i) for i in range(size)]
        self.runs = {len(p): p for p in self.rank if not p.strip(MARK)}
        self.alphabet = {p for p in self.rank if len(p) == 1}
        self.parts: dict[str, tuple[int, str, str]] = {}
        self.compatible: dict[tuple[str, str], bool] = {}
        self.halves: dict[str, tuple[str, str]] = {}
        self.automaton = ahocorasick.Automaton()
        for piece in sorted(self.rank, key=len):
            if piece.strip(MARK) == "" and len(piece) > 1:
                continue  # runs of marks merge last, from the left: see run_of_marks
            if len(piece) == 1 or self._learn_halves(piece):
                self.automaton.add_word(piece, (len(piece) - 1, piece))
        self.automaton.make_automaton()
        self.shorter = {p: self._longest_prefix(p) for p in self.automaton}
        # No piece holds one of these behind another character, so nothing merges across the place before them.
        inner = {c for p in self.rank for c in p[1:]}
        stops = "\n" + "".join(c for c in map(chr, range(33, 127)) if c not in inner)
        firm = re.escape(stops)
        # Nor does any piece hold a letter and then one of these.
        pairs = {p[i : i + 2] for p in self.rank for i in range(len(p) - 1)}
        tails = "".join(c for c in ".,;:!?|%&$#*" if not any(re.match(LETTER, a) and b == c for a, b in pairs))
        self.divider = re.compile(f"{MARK}*{LETTER}+(?=[{re.escape(tails)}{firm}])|{MARK}*[^{MARK}{firm}]+|{MARK}+|[{firm}]")
        for probe in PROBES:
            if self.encode(probe) != model.encode(probe, add_eos=True):
                raise ValueError(f"{model_path} normalizes text or has pieces of its own: unlike the library on {probe!r}")

    def merged(self, symbols: list[str]) -> tuple[list[str], tuple[str, str] | None]:
        """All merges in order of rank, leftmost first; and the two halves that merged last."""
        last = None
        while True:
            best = min(
                ((self.rank[a + b], i) for i, (a, b) in enumerate(zip(symbols, symbols[1:])) if a + b in self.rank), default=None
            )
            if best is None:
                return symbols, last
            i = best[1]
            last = (symbols[i], symbols[i + 1])
            symbols[i : i + 2] = [symbols[i] + symbols[i + 1]]

    def _learn_halves(self, piece: str) -> bool:
        """Keeps how ``piece`` comes about; False if merging its characters doesn't give it."""
        symbols, last = self.merged(list(piece))
        if len(symbols) != 1:
            return False
        self.halves[piece] = last
        return True

    def _longest_prefix(self, piece: str) -> str | None:
        return next((piece[:n] for n in range(len(piece) - 1, 0, -1) if piece[:n] in self.automaton), None)

    def fits(self, left: str, right: str) -> bool:
        """Whether merging both texts again keeps the border between them."""
        known = self.compatible.get((left, right))
        if known is None:
            if len(self.compatible) >= PAIRS:
                self.compatible.clear()
            known = self.compatible[left, right] = self._remerge(left, right)
        return known

    def _remerge(self, left: str, right: str) -> bool:
        """Takes the merges at the border back, latest first, and looks for an earlier one across it."""
        rank, halves = self.rank, self.halves
        before = (len(rank), 0)  # rank and side (0: left of the border) of the merge just taken back
        while True:
            across = rank.get(left + right)
            # At equal rank the leftmost merges first: the left side's before the border's, that before the right's.
            if across is not None and (across, 0.5) < before:
                return False
            made_left = (rank[left], 0) if left in halves else (-1, 0)
            made_right = (rank[right], 1) if right in halves else (-1, 1)
            if made_left[0] < 0 and made_right[0] < 0:
                return True
            if made_left > made_right:
                before, left = made_left, halves[left][1]
            else:
                before, right = made_right, halves[right][0]

    def backtrack(self, text: str) -> list[str]:
        """Pieces of a text whose characters are all in the alphabet."""
        size = len(text)
        longest: list[str | None] = [None] * (size + 1)
        for end, (less, piece) in self.automaton.iter(text):  # ends ascend, so the last from a place is the longest
            longest[end - less] = piece
        known, shorter = self.compatible.get, self.shorter
        open_places = bytearray(b"\1") * (size + 1)
        pieces: list[str] = []
        place, piece = 0, longest[0]
        while place < size:
            while piece is not None:
                end = place + len(piece)
                if open_places[end]:
                    if not pieces:
                        break
                    fits = known((pieces[-1], piece))
                    if fits or (fits is None and self.fits(pieces[-1], piece)):
                        break
                piece = shorter[piece]
            if piece is not None:
                pieces.append(piece)
                place, piece = end, longest[end]
            else:
                open_places[place] = 0
                piece = pieces.pop()
                place -= len(piece)
        return pieces

    def run_of_marks(self, n: int) -> list[str]:
        """Runs of marks share one score, so they grow from the left to the longest piece."""
        most = max(self.runs)
        found = []
        while n:
            take = min(n, most)
            while take not in self.runs:
                take -= 1
            found.append(self.runs[take])
            n -= take
        return found

    def part_pieces(self, part: str) -> list[str | int]:
        """Pieces of one part; a character outside the alphabet gives the ids of its bytes."""
        word = part.lstrip(MARK)
        marks = len(part) - len(word)
        if not word:
            return self.run_of_marks(marks)
        core = MARK + word if marks else word
        if marks < 2 and self.alphabet.issuperset(core):
            return self.backtrack(core)
        found: list[str | int] = []
        start = 0
        for i, c in enumerate(core):
            if c not in self.alphabet:
                found += self.long_backtrack(core[start:i])
                found += [self.byte_ids[b] for b in c.encode("utf-8", "surrogatepass")]
                start = i + 1
        found += self.long_backtrack(core[start:])
        if marks > 1:
            alone = found[0] == MARK
            found[: int(alone)] = self.run_of_marks(marks - (not alone))
        return found

    def long_backtrack(self, text: str) -> list[str]:
        return self.backtrack(text) if text else []

    def decoded(self, ids: list[int]) -> str:
        """Text of ids, marks as spaces; control ids vanish, bytes join into characters."""
        out: list[str] = []
        held = bytearray()
        surface = self.surface
        if all(i in surface for i in ids):
            return "".join([surface[i] for i in ids])
        for i in ids:
            if i in self.id_bytes:
                held.append(self.id_bytes[i])
                continue
            if held:
                out.append(held.decode("utf-8", "replace"))
                held.clear()
            out.append(surface.get(i, ""))
        if held:
            out.append(held.decode("utf-8", "replace"))
        return "".join(out)

    def part(self, part: str) -> tuple[int, str, str]:
        """Number of ids, the ids in decimal, and the decoded text of a part."""
        known = self.parts.get(part)
        if known is None:
            ids = [self.id_of.get(p, p) for p in self.part_pieces(part)]
            known = (len(ids), " ".join([self.decimal[i] for i in ids]), self.decoded(ids))
            if len(part) <= 64:
                if len(self.parts) >= REMEMBERED:
                    self.parts.clear()
                self.parts[part] = known
        return known

    def parts_of(self, text: str) -> list[tuple[int, str, str]]:
        if not text:
            return []
        get, make = self.parts.get, self.part
        return [get(p) or make(p) for p in self.divider.findall(MARK + text.replace(" ", MARK))]

    def encode(self, text: str) -> list[int]:
        """All ids, the end id last."""
        return [int(i) for _, ids, _ in self.parts_of(text) for i in ids.split()] + [self.end_id]

    def decode(self, ids: Iterable[int]) -> str:
        """The text of ids; the mark that encoding puts in front is taken off."""
        return self.decoded(list(ids)).removeprefix(" ")

    def digest(self, text: str) -> tuple[int, str, str]:
        """Number of ids, SHA-256 of the ids in decimal, SHA-256 of the decoded text."""
        found = self.parts_of(text)
        ids = " ".join([*(p[1] for p in found), str(self.end_id)])
        back = "".join([p[2] for p in found]).removeprefix(" ")
        return sum(p[0] for p in found) + 1, sha256(ids), sha256(back)


def sha256(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


_codecs: dict[str, PieceCodec] = {}


def codec(model_path: str) -> PieceCodec:
    """One codec for each model and Python worker."""
    if model_path not in _codecs:
        _codecs[model_path] = PieceCodec(model_path)
    return _codecs[model_path]


def encode_documents(docs: DataFrame, model_path: str, text_col: str = "text") -> DataFrame:
    """Rows of ``docs`` with ``ids`` (end id last) and ``decoded``.

    Null and the empty text give the end id alone.  Any length of text is encoded whole.
    The model file must be at ``model_path`` on every executor.
    """
    fields = StructType([StructField("ids", ArrayType(IntegerType())), StructField("decoded", StringType())])

    def maker():
        own = codec(model_path)

        def work(texts: list) -> list[list]:
            ids = [own.encode(t or "") for t in texts]
            return [ids, [own.decode(i) for i in ids]]

        return work

    return append_columns(docs, F.col(f"`{text_col}`"), fields, maker)


def token_digests(docs: DataFrame, model_path: str, text_col: str = "text") -> DataFrame:
    """Rows of ``docs`` with n_tokens, ids_sha256 and decoded_sha256: the same encoding, told by digests only."""
    fields = StructType(
        [StructField("n_tokens", LongType()), StructField("ids_sha256", StringType()), StructField("decoded_sha256", StringType())]
    )

    def maker():
        own = codec(model_path)
        return lambda texts: list(zip(*(own.digest(t or "") for t in texts), strict=True))

    return append_columns(docs, F.col(f"`{text_col}`"), fields, maker)
