"""Operators 3, 4 and 10 against the libraries and brute force."""

from __future__ import annotations

import random
import zlib

import numpy as np
import pytest

from planweft.llm import packing, pieces, token_orc, units

BITS = ["a", "b", "Ab", "é", "ß", "İ", "don't", "it's", ".", ",", "..", ".,", "1", "3.5", "x,y", "\n", "\t", "  ", "\x02", " ", "中", "́", "word.", "end,", "The", "<|endoftext|>", "'s", ". ", "\r\n", "Σας", "▁"]


def random_texts(seed, n):
    r = random.Random(seed)
    return ["".join(r.choice(BITS) + r.choice(["", " ", " "]) for _ in range(r.randint(0, 14))) for _ in range(n)]


@pytest.mark.parametrize("name, spaced", [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_units_give_the_library_ids(tokenizers_dir, make, name, spaced):
    from tokenizers import Tokenizer

    reference = Tokenizer.from_file(tokenizers_dir(name))
    library = units.Library(tokenizers_dir(name), spaced)
    for text in [*random_texts(1, 800), make(1, 500), make(2, 500)]:
        assert np.frombuffer(library.ids(text), "<u4").tolist() == reference.encode(text, add_special_tokens=False).ids, repr(text)


def test_sentencepiece_ids_and_texts(tokenizers_dir, make):
    import sentencepiece

    path = tokenizers_dir("piece_bpe_32k.model")
    reference, (vocabulary, cache, table) = sentencepiece.SentencePieceProcessor(model_file=path), pieces.of_file(path)
    for text in [*random_texts(2, 800), make(3, 400)]:
        ids = np.frombuffer(vocabulary.encode(text, cache), "<u4").tolist()
        assert ids == reference.encode(text), repr(text)
        assert vocabulary.decode(ids, table) == reference.decode(ids), repr(text)


def test_unigram_takes_the_largest_sum():
    scores = {"a": -1.0, "b": -1.0, "ab": -1.5, "abc": -5.0, "c": -1.0, "bc": -1.2}
    v = pieces.Vocabulary(pieces.UNIGRAM, ["<unk>", *scores], [0.0, *scores.values()], [2, *[1] * len(scores)], 0, [], True)
    v.build()
    name = lambda text: [v.pieces[i] for i in v.segment(text)]
    assert name("abc") == ["a", "bc"] and name("abab") == ["ab", "ab"] and name("axxb") == ["a", "<unk>", "b"] and name("") == []


def test_sentencepiece_frames(spark, odd_documents, no_documents, tokenizers_dir):
    path = tokenizers_dir("piece_bpe_32k.model")
    rows = pieces.decode(pieces.encode(odd_documents, path), path).collect()
    assert sorted(((r.doc_id or 0), r.text) for r in rows) == sorted(((r.doc_id or 0), r.text or "") for r in odd_documents.collect())
    assert pieces.digests(pieces.decode(pieces.encode(no_documents, path), path)).collect() == []


def test_plan_is_best_fit_decreasing():
    r = random.Random(5)
    for _ in range(60):
        capacity = r.choice([7, 20, 64])
        lengths = sorted((r.randint(1, capacity) for _ in range(r.randint(0, 80))), reverse=True)
        bins: list[int] = []
        for n in lengths:
            fit = min((b for b in range(len(bins)) if bins[b] >= n), key=lambda b: bins[b], default=None)
            if fit is None:
                bins.append(capacity)
                fit = len(bins) - 1
            bins[fit] -= n
        counts = {n: lengths.count(n) for n in lengths}
        filled: dict[int, list[tuple[int, int]]] = {}
        for n, first, last, each, start, offset in packing.plan_bins(counts, capacity):
            for rank in range(first, last):
                filled.setdefault(start + (rank - first) // each, []).append((offset + (rank - first) % each * n, n))
        assert sum(map(len, filled.values())) == len(lengths)
        rooms = []
        for parts in filled.values():
            at = 0
            for offset, n in sorted(parts):
                assert offset == at
                at += n
            rooms.append(capacity - at)
        assert sorted(rooms) == sorted(bins)


def check_packing(rows, texts, path, capacity):
    from tokenizers import Tokenizer

    reference = Tokenizer.from_file(path)
    wanted = []
    for doc, text in texts:
        ids = reference.encode(text or "", add_special_tokens=False).ids + [0]
        wanted += [(doc or 0, k, s, len(ids[s : s + capacity]), zlib.crc32(np.array(ids[s : s + capacity], "<u4").tobytes())) for k, s in enumerate(range(0, len(ids), capacity))]
    assert sorted((r.doc_id or 0, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == sorted(wanted)
    ends: dict[int, int] = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert ends.get(r.sequence_id, 0) == r.offset
        ends[r.sequence_id] = r.offset + r.length
    assert max(ends.values()) <= capacity
    return len(ends)


def test_packing(spark, odd_documents, no_documents, tokenizers_dir):
    path = tokenizers_dir("word_bpe_49k.json")
    rows = packing.pack(odd_documents.repartition(3), path, capacity=128).collect()
    n = check_packing(rows, [(r.doc_id, r.text) for r in odd_documents.collect()], path, 128)
    assert n <= 1.05 * sum(r.length for r in rows) / 128 + 1
    assert packing.pack(no_documents, path).collect() == []


def test_token_files(spark, odd_documents, no_documents, tokenizers_dir, tmp_path):
    from tokenizers import Tokenizer

    path, folder = tokenizers_dir("byte_bpe_50k.json"), f"file://{tmp_path}/tokens"
    reference = Tokenizer.from_file(path)
    found = token_orc.token_files(odd_documents, path, path=folder).collect()
    start = 0
    for doc, text in sorted(((r.doc_id if r.doc_id is not None else -1, r.text or "") for r in odd_documents.collect())):
        ids = reference.encode(text, add_special_tokens=False).ids + [2]
        assert any((r.doc_id if r.doc_id is not None else -1, r.start, r.n_tokens, r.ids_crc32) == (doc, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())) for r in found), (doc, text[:50])
        start += len(ids)
    assert len(found) == odd_documents.count()
    one = token_orc.read_tokens(spark, folder).where("doc_id = 8")
    assert one.count() == 1 and "PushedFilters: [IsNotNull(doc_id), EqualTo(doc_id,8)]" in one._jdf.queryExecution().toString()
    assert token_orc.token_files(no_documents, path).collect() == []


def test_orc_files_have_indexes_and_filters(spark, odd_documents, tokenizers_dir, tmp_path):
    import glob

    from pyarrow import orc

    token_orc.write_tokens(odd_documents, f"file://{tmp_path}/t", tokenizers_dir("byte_bpe_50k.json"), 2, partitions=1, index_stride=1000)
    (name,) = glob.glob(f"{tmp_path}/t/*.orc")
    file = orc.ORCFile(name)
    assert file.nrows == 14 and file.nstripes >= 1 and file.row_index_stride == 1000
    ids = [x for x in file.read(columns=["doc_id"])["doc_id"].to_pylist() if x is not None]
    assert ids == sorted(ids)


@pytest.mark.parametrize("name, spaced", [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_blocks_give_the_library_ids(tokenizers_dir, make, name, spaced, monkeypatch):
    """25,000 hostile texts in blocks, cut and uncut ones mixed."""
    import pyarrow as pa
    from tokenizers import Tokenizer

    reference, library = Tokenizer.from_file(tokenizers_dir(name)), units.Library(tokenizers_dir(name), spaced)
    monkeypatch.setattr(units, "LAID", 500)
    marks = ["$$", "###", "~", "`", "_x", "@b", "É", "ÿ", "µ", "word<", "<|startoftext|>", "]", "\\", "ﬁ", "ª", "Straße", "ÀÖ"]
    r = random.Random(31)
    texts = [*random_texts(7, 12_500), *("".join(r.choice(BITS + marks) + r.choice(["", " ", " ", "\n"]) for _ in range(r.randint(0, 12))) for _ in range(12_500)), make(4, 3000), None]
    r.shuffle(texts)
    at = 0
    for ids, ends in library.documents(pa.array(texts), 7):
        first = 0
        for end in ends.tolist():
            assert ids[first:end].tolist() == [*reference.encode(texts[at] or "", add_special_tokens=False).ids, 7], repr(texts[at])
            first, at = end, at + 1
    assert at == len(texts)
    assert list(library.encode(pa.array([], pa.string()))) == []


def test_orc_metadata_prunes(spark, tokenizers_dir, tmp_path):
    """Integers are run-length encoded, row indexes and Bloom filters are there, and a look-up by id reads a row group or none."""
    import glob

    from pyspark.sql import functions as F

    docs = spark.range(30_000).select((F.col("id") * 3).alias("doc_id"), F.concat(F.lit("number "), F.sha1(F.col("id").cast("string")), F.lit(" "), F.sha1((F.col("id") + 1).cast("string"))).alias("text"))
    folder = f"file://{tmp_path}/t"
    token_orc.write_tokens(docs, folder, tokenizers_dir("byte_bpe_50k.json"), 2, partitions=1, stripe_bytes=1 << 20)
    (name,) = glob.glob(f"{tmp_path}/t/*.orc")
    jvm = spark._jvm
    reader = jvm.org.apache.orc.OrcFile.createReader(jvm.org.apache.hadoop.fs.Path(name), jvm.org.apache.orc.OrcFile.readerOptions(spark._jsc.hadoopConfiguration()))
    assert reader.getStripes().size() >= 2
    footer = reader.rows().readStripeFooter(reader.getStripes().get(0))
    streams = {(s.getColumn(), s.getKind().toString()) for s in footer.getStreamsList()}
    assert (1, "BLOOM_FILTER_UTF8") in streams and all((c, "ROW_INDEX") in streams for c in range(1, 7))
    assert [c.getKind().toString() for c in footer.getColumnsList()][1:] == ["DIRECT_V2"] * 6
    for doc_id, most in ((3 * 4567, 1000), (3 * 4567 + 1, 0)):
        plan = token_orc.read_tokens(spark, folder).where(F.col("doc_id") == doc_id)._jdf.queryExecution().executedPlan()
        plan.executeCollect()
        assert plan.collectLeaves().apply(0).metrics().apply("numOutputRows").value() <= most
