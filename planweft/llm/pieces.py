"""Operator 3: SentencePiece encoding and decoding, by an Aho-Corasick automaton and one Viterbi pass.

The automaton over all pieces reads a text once; at each position its output
links give every piece that ends there, and each relaxes the best way to that
position. For a unigram model the best way has the largest sum of scores. A BPE
model has no such sum: its encoding of a text is the one in which every two
neighbouring pieces stay apart when merged by rank, and each prefix has exactly
one. So there a piece relaxes a position only if it may stand behind the last
piece of the way to its start. Characters in no piece fall back to bytes.
"""

from __future__ import annotations

import functools
import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planweft.llm.shared import only, text_or_empty, tidy
from planweft.llm.units import Units

SPACE = "▁"
#: No piece holds a space mark behind another character, nor a newline, so merges cross neither.
UNIT = re.compile(f"\\n|{SPACE}*[^{SPACE}\\n]+|{SPACE}+")
#: A word and the marks behind it; cut too where no piece holds a letter before such a mark.
TAIL = re.compile(f"({SPACE}*[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+)([.,!?;:]+)")
CROSSING = re.compile("[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f][.,!?;:]")
UNIGRAM, BPE = 1, 2
NORMAL, USER, BYTE, UNKNOWN = 1, 4, 6, 2


@dataclass
class Vocabulary:
    """Pieces of a model file, with the automaton over them."""

    kind: int
    pieces: list[str]
    scores: list[float]
    types: list[int]
    unknown: int
    bytes_: list[int]
    prefix: bool
    by_text: dict[str, int] = field(default_factory=dict)
    pairs: dict[int, bool] = field(default_factory=dict)  # left id << 32 | right id -> whether they stay apart

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as source:
            model.ParseFromString(source.read())
        spec = model.normalizer_spec
        if spec.precompiled_charsmap or spec.remove_extra_whitespaces or model.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("only models that leave their text as it is are supported")
        if model.trainer_spec.model_type not in (UNIGRAM, BPE):
            raise ValueError("neither a unigram nor a BPE model")
        texts, types = [p.piece for p in model.pieces], [p.type for p in model.pieces]
        at = [i for i, t in enumerate(types) if t == BYTE]
        made = cls(model.trainer_spec.model_type, texts, [p.score for p in model.pieces], types, types.index(UNKNOWN), at if len(at) == 256 else [], spec.add_dummy_prefix)
        made.build()
        return made

    def build(self) -> None:
        import ahocorasick

        self.by_text = {p: i for i, p in enumerate(self.pieces) if self.types[i] in (NORMAL, USER)}
        if any(SPACE in p.lstrip(SPACE) or "\n" in p for p in self.by_text):
            raise ValueError("a piece crosses a space or a newline")
        self.tails = any(map(CROSSING.search, self.by_text))
        self.automaton = ahocorasick.Automaton()
        for text, i in self.by_text.items():
            # a piece that its own merges don't reach is never part of a BPE encoding
            if self.kind == UNIGRAM or self.merged(text) == [text]:
                self.automaton.add_word(text, (i, len(text)))
        self.automaton.make_automaton()
        self.lowest = min(self.scores, default=0.0) - 10.0

    def merged(self, text: str) -> list[str]:
        """BPE by its definition, for the short texts of one or two pieces: join the best-ranked neighbours, leftmost first."""
        parts = list(text)
        while len(parts) > 1:
            joined = [(-self.scores[k], i) for i in range(len(parts) - 1) if (k := self.by_text.get(parts[i] + parts[i + 1])) is not None]
            if not joined:
                break
            i = min(joined)[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def apart(self, left: int, right: int) -> bool:
        """Whether two pieces stay two when their texts are merged together."""
        known = self.pairs.get(left << 32 | right)
        if known is None:
            if len(self.pairs) >= 300_000:
                self.pairs.clear()
            a, b = self.pieces[left], self.pieces[right]
            known = self.pairs[left << 32 | right] = self.merged(a + b) == [a, b]
        return known

    def segment(self, text: str) -> list[int]:
        """Ids of a text whose spaces are marks already."""
        last = self.relax_sums(text) if self.kind == UNIGRAM else self.relax_apart(text)
        ids, at = [], len(text)
        while at:
            i = last[at]
            if i >= 0:
                ids.append(i)
                at -= len(self.pieces[i])
                continue
            if self.bytes_:
                ids += [self.bytes_[b] for b in reversed(text[at - 1].encode())]
            elif not ids or ids[-1] != self.unknown:  # neighbouring unknown characters are one piece
                ids.append(self.unknown)
            at -= 1
        return ids[::-1]

    def relax_sums(self, text: str) -> list[int]:
        """For each position the last piece of the way of the largest sum; -1 for an unknown character."""
        n, scores = len(text), self.scores
        best, last, done = [float("-inf")] * (n + 1), [-1] * (n + 1), 0
        best[0] = 0.0
        for end, (i, length) in self.automaton.iter(text):
            end += 1
            for j in range(done + 1, end):  # all pieces that end there are known by now
                best[j] = max(best[j], best[j - 1] + self.lowest) if last[j] < 0 else best[j]
            done = end - 1
            value = best[end - length] + scores[i]
            if value > best[end]:
                best[end], last[end] = value, i
        return last

    def relax_apart(self, text: str) -> list[int]:
        """For each position the one piece that may stand behind the way to its start; -1 for an unknown character."""
        last = [-1] * (len(text) + 1)
        pairs = self.pairs
        for end, (i, length) in self.automaton.iter(text):
            end += 1
            if last[end] < 0:
                start = end - length
                before = last[start]
                if not start or before < 0:
                    last[end] = i
                else:
                    known = pairs.get(before << 32 | i)
                    if self.apart(before, i) if known is None else known:
                        last[end] = i
        return last

    def units(self) -> Units:
        def encode(unit: str) -> bytes:
            if self.kind == BPE and (found := TAIL.fullmatch(unit)) and not self.tails:
                return units[found[1]] + units[found[2]]
            return np.asarray(self.segment(unit), "<u4").tobytes()

        units = Units(encode, most=250_000)
        return units

    def encode(self, text: str, units: Units) -> bytes:
        """Little-endian 32-bit ids of a whole text."""
        if not text:
            return b""
        marked = (SPACE if self.prefix else "") + text.replace(" ", SPACE)
        if self.kind == UNIGRAM and not self.bytes_:
            return np.asarray(self.segment(marked), "<u4").tobytes()  # unknown characters may join across a cut
        return b"".join(map(units.__getitem__, UNIT.findall(marked)))

    def decoder(self) -> list[bytes]:
        """The bytes that each id stands for; control pieces stand for none."""
        own = {i: bytes([b]) for b, i in enumerate(self.bytes_)}
        return [own[i] if i in own else p.encode() if self.types[i] in (NORMAL, USER) else " ⁇ ".encode() if self.types[i] == UNKNOWN else b"" for i, p in enumerate(self.pieces)]

    def decode(self, ids: list[int], table: list[bytes]) -> str:
        text = b"".join(map(table.__getitem__, ids)).decode("utf-8", "replace").replace(SPACE, " ")
        return text[1:] if self.prefix and text[:1] == " " else text


@functools.cache
def of_file(path: str) -> tuple[Vocabulary, Units, list[bytes]]:
    """A model's vocabulary, units and decoding table, kept as long as the worker process lives."""
    vocabulary = Vocabulary.load(path)
    return vocabulary, vocabulary.units(), vocabulary.decoder()


def encode(df: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, ids binary`` (little-endian unsigned 32-bit) of every whole text.

    Null and empty texts have no ids. Ids and rows may repeat or be null; other
    columns are ignored. A space mark in the text itself counts as a space.
    """

    def run(batches):
        vocabulary, units, _ = of_file(model)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                some = batch.slice(at, 256)
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array([vocabulary.encode(t or "", units) for t in some.column(1).to_pylist()], pa.binary())], names=["doc_id", "ids"])

    return only(df, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty("text").alias("text")).mapInArrow(tidy(run), "doc_id long, ids binary")


def decode(encoded: DataFrame, model: str) -> DataFrame:
    """``doc_id, ids, text`` from what :func:`encode` gives; null ids stand for an empty text."""

    def run(batches):
        vocabulary, _, table = of_file(model)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                some = batch.slice(at, 256)
                texts = [vocabulary.decode(np.frombuffer(x or b"", "<u4").tolist(), table) for x in some.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([*some.columns, pa.array(texts, pa.string())], names=["doc_id", "ids", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(tidy(run), "doc_id long, ids binary, text string")


def digests(decoded: DataFrame) -> DataFrame:
    """``doc_id, n_pieces, ids_crc32, text_crc32, ids`` of what :func:`decode` gives, by built-in functions."""
    return decoded.select(
        "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_pieces"), F.crc32("ids").alias("ids_crc32"), F.crc32(F.encode("text", "utf-8")).alias("text_crc32"), "ids",
    )
