"""SentencePiece BPE by a prefix table: one last token per prefix, read backwards.

Cut a BPE encoding between any two tokens and both parts are the encodings of
their texts.  So every prefix that ends at a token has one last token, and a
token may follow another exactly if the encoding of the two together is the two
of them.  The table goes from left to right: at every place, the tokens that
end there come from an automaton over the vocabulary; the one that is
compatible with the last token of the prefix before it is the entry.  The ids
are recovered from the end.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from speccurve.llm.common import map_texts, per_worker

SPACE = "▁"
# Segments whose ids a task remembers, twice at most, and pairs of tokens.
REMEMBERED_SEGMENTS = 400_000
REMEMBERED_PAIRS = 1_000_000
LONG_TEXT = 1 << 20


class PieceEncoder:
    """Encodes as the library does with a BPE model without normalisation rules."""

    def __init__(self, model: bytes) -> None:
        import ahocorasick
        from sentencepiece import SentencePieceProcessor

        self.library = lib = SentencePieceProcessor(model_proto=model)
        self.score: dict[str, float] = {}
        self.ids: dict[str, int] = {}
        bytes_at = {}
        for i in range(lib.get_piece_size()):
            piece = lib.id_to_piece(i)
            if lib.is_byte(i):
                bytes_at[int(piece[3:5], 16)] = i
            elif not (lib.is_control(i) or lib.is_unknown(i) or lib.is_unused(i)):
                self.score[piece] = lib.get_score(i)
                self.ids[piece] = i
        self.byte_ids = [bytes_at.get(b, lib.unk_id()) for b in range(256)]
        self.fallback = bool(bytes_at)
        self.unknown = lib.unk_id()
        if SPACE not in lib.encode("a b", out_type=str)[-1] or lib.encode(" a  b ") != self._plain(
            " a  b "
        ):
            raise ValueError("the model normalises white space in another way")
        # Only pieces that encode to themselves are ever a token.
        self.automaton = ahocorasick.Automaton()
        self.texts: list[str] = []
        for piece in self.score:
            if len(self._merge(piece)) == 1:
                self.automaton.add_word(piece, (len(self.texts), len(piece)))
                self.texts.append(piece)
        self.automaton.make_automaton()
        self.token_ids = [self.ids[t] for t in self.texts]
        self.heads = [self._edges(t, False) for t in self.texts]
        self.tails = [self._edges(t, True) for t in self.texts]
        self.pairs: dict[int, bool] = {}
        self.fresh: dict[str, bytes] = {}
        self.stale: dict[str, bytes] = {}
        self.segments = _segmenter(self.score)

    def _plain(self, text: str) -> list[int]:
        out = []
        for part in self._merge((SPACE + text).replace(" ", SPACE)):
            out += self._symbol(part)
        return out

    def _merge(self, text: str) -> list[str]:
        """The definition: merge the best neighbours, leftmost first, until none is left."""
        left = list(range(-1, len(text) - 1))
        right = [*range(1, len(text)), -1]
        part: list[str | None] = list(text)
        heap: list[tuple[float, int, int, str]] = []

        def offer(a: int, b: int) -> None:
            if a >= 0 and b >= 0 and (joined := part[a] + part[b]) in self.score:
                heapq.heappush(heap, (-self.score[joined], a, b, joined))

        for at in range(len(text) - 1):
            offer(at, at + 1)
        while heap:
            _, a, b, joined = heapq.heappop(heap)
            if part[a] is None or part[b] is None or right[a] != b or part[a] + part[b] != joined:
                continue
            part[a], part[b] = joined, None
            right[a] = right[b]
            if right[b] >= 0:
                left[right[b]] = a
            offer(left[a], a)
            offer(a, right[a])
        return [p for p in part if p is not None]

    def _edges(self, token: str, at_end: bool) -> frozenset[str]:
        """What may stand at the end (start) of ``token`` while it is merged."""
        cuts = range(1, len(token) + 1)
        return frozenset(
            t for k in cuts
            if (t := token[-k:] if at_end else token[:k]) in self.score or k == 1
        )

    def _compatible(self, a: int, b: int) -> bool:
        """Is the encoding of the two texts together the two tokens?"""
        joined = self.score
        if not any(x + y in joined for x in self.tails[a] for y in self.heads[b]):
            return True
        return self._merge(self.texts[a] + self.texts[b]) == [self.texts[a], self.texts[b]]

    def _symbol(self, text: str) -> list[int]:
        """Ids of one symbol: a piece, or the bytes of an unknown character."""
        known = self.ids.get(text)
        if known is not None:
            return [known]
        if not self.fallback:
            return [self.unknown]
        return [self.byte_ids[b] for b in text.encode("utf-8", "surrogatepass")]

    def table(self, text: str) -> list[int]:
        """Ids of a segment, by the prefix table."""
        n = len(text)
        last = [-1] * (n + 1)  # number of the last token of the prefix; -2: unknown character
        back = [0] * (n + 1)  # where that token starts
        reached = bytearray(n + 1)
        reached[0] = 1
        pairs = self.pairs
        done = 0
        for end, (token, size) in self.automaton.iter(text):
            at, start = end + 1, end + 1 - size
            while done < end:  # no token ends at these places: unknown characters
                done += 1
                if not reached[done] and reached[done - 1] and text[done - 1] not in self.score:
                    reached[done], last[done], back[done] = 1, -2, done - 1
            if reached[at] or not reached[start]:
                continue
            before = last[start]
            if before >= 0:
                pair = before << 20 | token
                fits = pairs.get(pair)
                if fits is None:
                    fits = pairs[pair] = self._compatible(before, token)
                if not fits:
                    continue
            reached[at], last[at], back[at] = 1, token, start
        for at in range(done + 1, n + 1):
            if not reached[at] and reached[at - 1] and text[at - 1] not in self.score:
                reached[at], last[at], back[at] = 1, -2, at - 1
        out = []
        at = n
        while at > 0:
            start = back[at]
            if last[at] >= 0:
                out.append(self.token_ids[last[at]])
            else:
                out += reversed(self._symbol(text[start:at]))
            at = start
        out.reverse()
        return out

    def encode(self, text: str) -> bytes:
        """Little-endian 32-bit ids of a whole text."""
        if not text:
            return b""
        out = []
        for part in _pieces_of(SPACE + text.replace(" ", SPACE)):
            out.append(self._known(self.segments(part)))
        return b"".join(out) if len(out) > 1 else out[0]

    def _known(self, segments: list[str]) -> bytes:
        fresh, stale = self.fresh, self.stale
        for segment in set(segments).difference(fresh):
            ids = stale.get(segment)
            if ids is None:
                ids = np.array(self.table(segment), "<i4").tobytes()
            fresh[segment] = ids
        out = b"".join(map(fresh.__getitem__, segments))
        if len(fresh) > REMEMBERED_SEGMENTS:
            self.fresh, self.stale = {}, fresh
        if len(self.pairs) > REMEMBERED_PAIRS:
            self.pairs = {}
        return out


def _pieces_of(text: str) -> Iterator[str]:
    """``text`` in parts of bounded length, cut before a space after another character."""
    at = 0
    while len(text) - at > LONG_TEXT:
        cut = re.compile(f"[^{SPACE}](?={SPACE})").search(text, at + LONG_TEXT)
        if cut is None:
            break
        yield text[at : cut.end()]
        at = cut.end()
    yield text[at:] if at else text


def _segmenter(pieces):
    """Splits a text only between characters that no piece of the vocabulary
    has in a row, so that no token ever lies across a cut.

    A space begins a segment: pieces hold spaces only at their start.  Line
    ends, and letters before a mark or line end, are apart if no piece of the
    model joins them.
    """
    beside: dict[str, set[str]] = {}
    for piece in pieces:
        for a, b in zip(piece, piece[1:]):
            beside.setdefault(a, set()).add(b)
    if any(SPACE in after for a, after in beside.items() if a != SPACE):
        raise ValueError("a piece of the model goes on after a space")
    if not {c for piece in pieces for c in piece} <= set(pieces):
        raise ValueError("a character of a piece is no piece")
    after_letters = set().union(*[after for a, after in beside.items() if a.isalpha()])
    marks = "".join(c for c in ",.;:!?" if c not in after_letters)
    if "\n" in beside or any("\n" in after for after in beside.values()):
        return re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+").findall
    stop = f"(?=[{re.escape(marks)}{SPACE}\n]|$)"
    return re.compile(
        f"{SPACE}*[^\\W\\d_]++{stop}|{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n+"
    ).findall


def encode_pieces(
    df: DataFrame, model: str, key: str = "doc_id", text: str = "text", keep: tuple = ()
) -> DataFrame:
    """key, ids array<int> and ``decoded``: every whole text encoded by the
    prefix table, and those ids decoded by the library.

    The same ids as the library's, without begin and end ids.  A null text
    counts as an empty one and has no ids; repeated rows stay; an empty table
    gives no rows.  ``keep`` names columns that are handed on; others with the
    names of the results are not in the way.
    """
    blob = df.sparkSession.sparkContext.broadcast(open(model, "rb").read())
    types = [(f"k{i}", df.schema[c].dataType.simpleString()) for i, c in enumerate((key, *keep))]

    def start():
        encoder = per_worker(PieceEncoder, blob.value)

        def work(columns):
            coded = [encoder.encode(x or "") for x in columns[-1].to_pylist()]
            sizes = np.cumsum([0, *[len(x) // 4 for x in coded]]).astype(np.int32)
            flat = np.frombuffer(b"".join(coded), "<i4")
            decoded = [
                encoder.library.decode(np.frombuffer(x, "<i4").tolist()) if x else ""
                for x in coded
            ]
            ids = pa.ListArray.from_arrays(pa.array(sizes), pa.array(flat))
            return [*columns[:-1], ids, pa.array(decoded, pa.string())]

        return work

    schema = ", ".join([f"{n} {t}" for n, t in types] + ["ids array<int>", "decoded string"])
    narrow = df.select(
        *[F.col(c).alias(n) for (n, _), c in zip(types, (key, *keep), strict=True)],
        F.col(text).alias("t"),
    )
    out = map_texts(narrow, [n for n, _ in types] + ["t"], schema, start)
    return out.withColumnsRenamed(
        dict(zip([n for n, _ in types], (key, *keep), strict=True))
    )
