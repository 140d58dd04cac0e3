"""Exact merge-type piece encoding by backtracking, and decoding.

The vocabulary file is read, never trained. Text is escaped as the model says
(a blank becomes the mark ``▁``, one mark is put in front) and cut before each
run of marks that follows other text and between words and punctuation; no piece
of such a vocabulary spans these places (established when it is read), so the
parts encode on their own and a bounded memory of recent parts can be reused.

One part is encoded without merging it from its characters: from each place the
longest piece (Aho-Corasick) is tried, then its shorter prefixes; a piece may
follow another only if re-merging the two together gives back exactly these two;
a bitfield marks the places from which no compatible way led on.

Defined cases: a null or empty text has no ids and decodes to the empty text.
Characters outside the vocabulary become byte pieces. Repeated rows and rows
without id are encoded like any other. Only the named columns are read.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
#: parts remembered by a task (in each of two generations), the longest one, and pairs remembered
MEMORY, LONGEST, PAIRS = 250_000, 64, 500_000


class Pieces:
    """A piece vocabulary with scores (higher merges first) and byte fallback."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.text = [model.id_to_piece(i) for i in range(model.get_piece_size())]
        special = [model.is_control(i) or model.is_unknown(i) or model.is_unused(i) for i in range(len(self.text))]
        self.byte = {int(self.text[i][3:5], 16): i for i in range(len(self.text)) if model.is_byte(i)}
        self.value = {i: b for b, i in self.byte.items()}
        self.silent = {i for i in range(len(self.text)) if model.is_control(i)}
        #: decimal ids, and what each id decodes to where its neighbours don't matter
        self.digits = [str(i) for i in range(len(self.text))]
        self.plain = [chr(self.value[i]) if i in self.value else "" if i in self.silent else t.replace(MARK, " ") for i, t in enumerate(self.text)]
        self.unknown = model.unk_id()
        self.joint = {self.unknown, *(i for i, b in self.value.items() if b > 127)}
        self.score = {t: model.get_score(i) for i, t in enumerate(self.text) if not special[i] and i not in self.value}
        self.id = {t: i for i, t in enumerate(self.text) if t in self.score}
        if len(self.byte) != 256:
            raise ValueError("the vocabulary has no byte fallback")
        if any(MARK in t.lstrip(MARK) for t in self.score):
            raise ValueError("a piece spans a mark inside; parts would depend on each other")
        if any(c not in self.score for t in self.score for c in t):
            raise ValueError("a piece has a character that is no piece itself")
        self.cut = self._cut()
        #: pieces that merging can make at all
        self.reached = {t for t in self.score if len(t) == 1 or self.merge(t) == [t]}
        self.machine = ahocorasick.Automaton()
        for t in self.reached:
            self.machine.add_word(t, t)
        self.machine.make_automaton()
        self.shorter: dict[str, str] = {}
        same = {t: t for t in self.reached}
        for t in self.reached:
            self.shorter[t] = next((same[t[:n]] for n in range(len(t) - 1, 0, -1) if t[:n] in same), "")
        self.pairs: dict[tuple[str, str], bool] = {}
        self.parts: dict[str, tuple[int, ...]] = {}
        self.older: dict[str, tuple[int, ...]] = {}

    def _cut(self) -> re.Pattern:
        """Splits escaped text where no piece can lie.

        ``apart`` is what is left of the ASCII characters other than letters and
        digits once those are gone that share a piece with other characters.
        """
        apart = {c for c in map(chr, range(128)) if not c.isalnum()}
        bodies = [set(t.lstrip(MARK)) for t in self.score]
        while mixed := {c for b in bodies if b & apart and not b <= apart for c in b & apart}:
            apart -= mixed
        inner = "".join(map(re.escape, sorted(apart)))
        return re.compile(f"{MARK}*[^{MARK}{inner}]+|{MARK}*[{inner}]+|{MARK}+" if inner else f"{MARK}*[^{MARK}]+|{MARK}+")

    def merge(self, text: str) -> list[str]:
        """Plain merging of a short text: always the best-scored pair, leftmost first."""
        syms: list[str | None] = list(text)
        right = list(range(1, len(syms) + 1))
        left = list(range(-1, len(syms) - 1))
        queue: list[tuple[float, int, str]] = []

        def offer(a: int) -> None:
            b = right[a] if a >= 0 else len(syms)
            if a >= 0 and b < len(syms) and (s := self.score.get(joined := syms[a] + syms[b])) is not None:
                heapq.heappush(queue, (-s, a, joined))

        for a in range(len(syms) - 1):
            offer(a)
        while queue:
            _, a, joined = heapq.heappop(queue)
            b = right[a]
            if syms[a] is None or b >= len(syms) or syms[a] + syms[b] != joined:
                continue
            syms[a], syms[b] = joined, None
            right[a] = right[b]
            if right[a] < len(syms):
                left[right[a]] = a
            offer(left[a])
            offer(a)
        return [s for s in syms if s is not None]

    def forget(self) -> None:
        """What was remembered goes at the end of a task, as its worker may serve other stages next."""
        self.pairs, self.parts, self.older = {}, {}, {}
        pa.default_memory_pool().release_unused()

    def compatible(self, a: str, b: str) -> bool:
        known = self.pairs.get((a, b))
        if known is None:
            if len(self.pairs) >= PAIRS:
                self.pairs.clear()
            known = self.pairs[a, b] = self.merge(a + b) == [a, b]
        return known

    def backtrack(self, text: str) -> list[str]:
        """The pieces of a text whose characters are all in the vocabulary."""
        n = len(text)
        longest = [""] * (n + 1)
        for end, found in self.machine.iter(text):
            # the matches that end at a place come longest first
            start = end - len(found) + 1
            if len(found) > len(longest[start]):
                longest[start] = found
        if len(longest[0]) == n:
            return [longest[0]]
        known, shorter = self.pairs.get, self.shorter
        failed = bytearray(n // 8 + 1)  # one bit per place
        out: list[str] = []
        at, before, piece = 0, "", longest[0]
        while at < n:
            end = at + len(piece)
            if not failed[end >> 3] >> (end & 7) & 1:
                fits = known((before, piece)) if before else True
                if fits or fits is None and self.compatible(before, piece):
                    out.append(piece)
                    at, before, piece = end, piece, longest[end]
                    continue
            piece = shorter[piece]
            while not piece:
                # nothing that starts here leads on: mark the place, shorten what led to it
                failed[at >> 3] |= 1 << (at & 7)
                last = out.pop()
                at -= len(last)
                before = out[-1] if out else ""
                piece = shorter[last]
        return out

    def part(self, text: str) -> list[int]:
        ids: list[int] = []
        start = 0
        for i, c in enumerate(text):
            if c not in self.score:
                if i > start:
                    ids.extend(self.id[p] for p in self.backtrack(text[start:i]))
                ids.extend(self.byte[b] for b in c.encode())
                start = i + 1
        if start < len(text):
            ids.extend(self.id[p] for p in self.backtrack(text[start:]))
        return ids

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        ids: list[int] = []
        known = self.parts
        for part in self.cut.findall(MARK + text.replace(" ", MARK)):
            got = known.get(part)
            if got is None:
                got = self.older.get(part)
                if got is None:
                    got = tuple(self.part(part))
                if len(part) <= LONGEST:
                    if len(known) >= MEMORY:
                        self.older, self.parts = known, {}
                        known = self.parts
                    known[part] = got
            ids += got
        return ids

    def decode(self, ids: list[int]) -> str:
        """Pieces joined, marks turned into blanks, the mark put in front taken off."""
        if self.joint.isdisjoint(ids):
            text = "".join(map(self.plain.__getitem__, ids))
            head = next((i for i in ids if i not in self.silent), None)
            return text[1:] if head is not None and self.text[head].startswith(MARK) else text
        out: list[str] = []
        held = bytearray()
        first = True
        for i in ids:
            if i in self.value:
                held.append(self.value[i])
                first = False
                continue
            if held:
                out.append(held.decode("utf-8", "replace"))
                held.clear()
            if i in self.silent:
                continue
            piece = " ⁇ " if i == self.unknown else self.text[i].replace(MARK, " ")
            out.append(piece[1:] if first and piece.startswith(" ") and i != self.unknown else piece)
            first = False
        if held:
            out.append(held.decode("utf-8", "replace"))
        return "".join(out)


_loaded: dict[str, Pieces] = {}


def pieces(path: str) -> Pieces:
    """The vocabulary, read once in a worker."""
    if path not in _loaded:
        _loaded[path] = Pieces(path)
    return _loaded[path]


def _per_text(docs: DataFrame, path: str, id_col: str, text_col: str, tail: str, names: list[str], make) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pieces(path)
        try:
            for whole in batches:
                for at in range(0, whole.num_rows, 512):
                    part = whole.slice(at, 512)
                    yield pa.RecordBatch.from_arrays([part.column(0), *make(model, part.column(1).to_pylist())], names=["id", *names])
        finally:
            model.forget()

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, {tail}").withColumnRenamed("id", id_col)


def encoded(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Ids (array of int) of each whole text, and the text they decode to."""
    def make(model: Pieces, texts: list[str | None]) -> list[pa.Array]:
        ids = [model.encode(t) for t in texts]
        return [pa.array(ids, pa.list_(pa.int32())), pa.array([model.decode(x) for x in ids], pa.string())]

    return _per_text(docs, path, id_col, text_col, "ids array<int>, decoded string", ["ids", "decoded"], make)


def digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``encoded`` with each list and text replaced by its length and digest in the task itself."""
    def make(model: Pieces, texts: list[str | None]) -> list[pa.Array]:
        ids = [model.encode(t) for t in texts]
        sha = lambda s: hashlib.sha256(s.encode("utf-8", "surrogatepass")).hexdigest()
        return [pa.array([len(x) for x in ids], pa.int64()), pa.array([sha(",".join(map(model.digits.__getitem__, x))) for x in ids], pa.string()),
                pa.array([sha(model.decode(x)) for x in ids], pa.string())]

    return _per_text(docs, path, id_col, text_col, "n_tokens long, ids_sha256 string, decoded_sha256 string",
                     ["n_tokens", "ids_sha256", "decoded_sha256"], make)
