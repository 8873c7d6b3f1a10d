"""Operator 9: exact Jaccard join of shingle sets, with set-relation skipping.

The join finds which documents are linked and gives their components;
``jaccard_links`` counts each document's links as well.

1. A counting filter drops sets that can have no partner: in the order of their
   hashes, linked sets share at least a known number of their first shingles, so
   a set with fewer shingles that any other set has there too is alone.
2. Equal sets become one.
3. Shingles are ordered by the number of sets that have them, rare first, and
   each set is indexed by its prefix in that order.
4. Set relations: every set is compared with a leader, the set of its prefix
   lists that shares most with others. Sets linked with their leader are one
   component, and their difference from the leader is kept.
5. Index lists hold what can still join two components: lists whose sets are all
   in one are dropped. While the rest could hold many pairs, another round gives each
   list another leader, compares its sets of other components with that, and refreshes the
   components: a family of n sets costs n comparisons a round, not a square.
6. The lists that are left are split into blocks of bounded size; inside, entries are sorted by set size, and whole
   blocks are skipped by size, by position (too little is left behind it) and if
   all their sets are in one component. What remains passes a parity bitmap that
   bounds the difference of two sets.
7. A candidate's overlap is derived from its leader's: the overlap of the leader
   with the other set, computed once for all its followers, less what the
   follower lacks, plus what it adds.

Every step is exact for the given hashes: a link is missed by none.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planweft.llm import graph
from planweft.llm.shared import cut, few_files, only, parallelism, place_of, positional, text_or_empty, tidy
from planweft.llm.shingles import mix, sets_of

FLUSH = 1 << 20
LIST_BLOCK = 256
SKIP_BLOCK = 32
#: Rounds of leaders at most, and the length of lists, on average over their entries, up to which pairs cost less than a round.
ROUNDS = 12
SHORT = 1024
#: Ids of 8 bytes that may be sent to every task; more are joined by a shuffle.
SMALL_IDS = 4_000_000
#: Pairs with one leader that a task compares at most.
LED = 1024
#: Bytes of text, and shingles, for each bucket that shingles are dealt to.
BUCKET_BYTES = 32 << 20
BUCKET_TOKENS = 2 << 20
#: Sets of a tile, and tokens of a membership matrix, where the links of a component are counted.
TILE = 256
TOKENS = 4096


def needed(n: np.ndarray | int, percent: int):
    """Least overlap of a set of n with any partner: ceil(percent * n / 100)."""
    return (percent * n + 99) // 100


def slack(n: np.ndarray | int):
    """How many shared shingles beyond one the counting filter looks for."""
    return n // 10


def texts(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return only(df, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty("text").alias("text"))


def in_parts(batch: pa.RecordBatch, rows: int = 500):
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def signature(s: np.ndarray) -> str:
    """Names a whole set: its size and two 64-bit sums."""
    return f"{len(s):x}-{int(s.sum(dtype=np.uint64)):x}-{int(mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)):x}"


def signed(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, n_shingles, signature of every row."""

    def run(batches):
        for batch in batches:
            for some in in_parts(batch):
                sets = sets_of(some.column(1), k)
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(map(signature, sets), pa.string())], names=["doc_id", "n_shingles", "signature"])

    return docs.mapInArrow(tidy(run), "doc_id long, n_shingles long, signature string")


def stable_order(key: np.ndarray) -> np.ndarray:
    """``np.argsort(key, kind="stable")`` of 32-bit keys from 0 on, by one sort of keys and places together."""
    return (np.sort(key.astype(np.uint64) << np.uint64(32) | np.arange(len(key), dtype=np.uint64)) & np.uint64(0xFFFFFFFF)).astype(np.int64)


class Dealer:
    """Collects (bucket, columns...) in memory up to a bound, combines them and deals them out in one packed row per bucket."""

    def __init__(self, buckets: int, names: list[str], combine=lambda *columns: columns):
        self.buckets, self.names, self.combine, self.held, self.rows = buckets, names, combine, [], 0

    def add(self, bucket: np.ndarray, *columns: np.ndarray):
        self.held.append((bucket, *columns))
        self.rows += len(bucket)
        if self.rows >= FLUSH:
            yield from self.flush()

    def flush(self):
        if not self.rows:
            return
        bucket, *columns = self.combine(*(np.concatenate(x) for x in zip(*self.held, strict=True)))
        self.held, self.rows = [], 0
        order = stable_order(bucket)
        ends = np.searchsorted(bucket[order], np.arange(self.buckets + 1))
        full = np.flatnonzero(np.diff(ends))
        blobs = [pa.array([c[order[ends[b] : ends[b + 1]]].tobytes() for b in full], pa.binary()) for c in columns]
        yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), *blobs], names=["bucket", *self.names])


def gathered(batches, kinds: list[str]):
    """The columns of all packed rows of a partition, whole."""
    parts = [[np.frombuffer(x, k) for x, k in zip(row, kinds, strict=True)] for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns[1:]), strict=True)]
    return [np.concatenate(x) for x in zip(*parts, strict=True)] if parts else [np.zeros(0, k) for k in kinds]


def buckets_for(spark, size: int | None, each: int) -> int:
    """How many buckets to deal to: as many as the session shuffles to, and more where ``size`` needs them."""
    return max(parallelism(spark), -(-int(size or 0) // each))


def combined(bucket: np.ndarray, key: np.ndarray, doc: np.ndarray, n: np.ndarray, buckets: int):
    """Postings of one key that meet here know already that it is shared: they go home by any bucket (a negative n), and one mark (doc and n 0) stands for them."""
    order = stable_order(key)
    bucket, key, doc, n = bucket[order], key[order], doc[order], n[order]
    same = key[1:] == key[:-1]
    again = np.zeros(len(key), bool)
    again[1:] = same
    again[:-1] |= same
    first = again & np.concatenate([[True], ~same])
    home = (mix(doc[again].astype(np.uint64)) % np.uint64(buckets)).astype(np.int32)
    parts = [bucket[~again], bucket[first], home], [key[~again], key[first], key[again]], [doc[~again], np.zeros(first.sum(), np.int64), doc[again]], [n[~again], np.zeros(first.sum(), np.int32), -n[again]]
    return tuple(map(np.concatenate, parts))


def maybe_linked(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """doc_id of the rows that the counting filter can't rule out."""
    # a quarter of a text's shingles, at most one for two of its bytes, at 16 bytes
    buckets = buckets_for(docs.sparkSession, docs.select(F.sum(F.octet_length("text").cast("long"))).collect()[0][0], BUCKET_BYTES)

    def deal(batches):
        dealer = Dealer(buckets, ["key", "doc", "n"], lambda *columns: combined(*columns, buckets))
        for batch in batches:
            for some in in_parts(batch.filter(batch.column(0).is_valid())):
                sets = [s for s in sets_of(some.column(1), k)]
                n = np.array([len(s) for s in sets], np.int64)
                first = np.where(n > 0, np.minimum(n, n - needed(n, percent) + 1 + slack(n)), 0)
                token = np.concatenate([s[:p] for s, p in zip(sets, first, strict=True)] or [np.zeros(0, np.uint64)])
                spread = mix(token)
                yield from dealer.add((spread % np.uint64(buckets)).astype(np.int32), (spread >> np.uint64(32)).astype(np.uint32), np.repeat(some.column(0).to_numpy(), first), np.repeat(n.astype(np.int32), first))
        yield from dealer.flush()

    def count(batches):
        key, doc, n = gathered(batches, ["<u4", "<i8", "<i4"])
        if not len(key):
            return
        known = n < 0
        homeward = [(doc[known], -n[known])]
        key, doc, n = key[~known], doc[~known], n[~known]
        order = stable_order(key)
        key, doc, n = key[order], doc[order], n[order]
        same = key[1:] == key[:-1]
        again = np.zeros(len(key), bool)
        again[1:] = same
        again[:-1] |= same
        again &= n > 0  # marks have no set of their own
        homeward.append((doc[again], n[again]))
        homes = Dealer(buckets, ["doc", "n"])
        for doc, n in homeward:
            yield from homes.add((mix(doc.astype(np.uint64)) % np.uint64(buckets)).astype(np.int32), doc, n)
        yield from homes.flush()

    def enough(batches):
        doc, n = gathered(batches, ["<i8", "<i4"])
        order = np.lexsort((n, doc))
        doc, n = doc[order], n[order].astype(np.int64)
        starts = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (n[1:] != n[:-1])])) if len(doc) else np.zeros(0, np.int64)
        shared = np.diff(np.append(starts, len(doc)))
        # a partner has at least ceil(percent * n / 100) shingles, and the lesser slack of the two counts
        kept = doc[starts[shared >= 1 + slack(needed(n[starts], percent))]]
        yield pa.RecordBatch.from_arrays([pa.array(np.unique(kept), pa.int64())], names=["doc_id"])

    dealt = docs.mapInArrow(tidy(deal), "bucket int, key binary, doc binary, n binary").repartitionById(buckets, F.col("bucket"))
    return dealt.mapInArrow(tidy(count), "bucket int, doc binary, n binary").repartitionById(buckets, F.col("bucket")).mapInArrow(tidy(enough), "doc_id long")


def whole_sets(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, signature, tokens (sorted hashes) of the rows whose text has words."""

    def run(batches):
        for batch in batches:
            for some in in_parts(batch):
                sets = sets_of(some.column(1), k)
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(map(signature, sets), pa.string()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["doc_id", "signature", "tokens"])

    return docs.mapInArrow(tidy(run), "doc_id long, signature string, tokens binary").where(F.octet_length("tokens") > 0)


def ordered(sets: DataFrame, percent: int) -> DataFrame:
    """rep, n, weight, tokens and counts: each set's tokens by (number of sets that have them, hash), with those numbers for its prefix.

    Tokens go to buckets by hash to be counted, and back to buckets by set, packed both ways.
    """
    buckets = buckets_for(sets.sparkSession, sets.select(F.sum(F.octet_length("tokens").cast("long"))).collect()[0][0], 8 * BUCKET_TOKENS)

    def deal(batches):
        dealer = Dealer(buckets, ["token", "rep"])
        for batch in batches:
            for rep, tokens in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                token = np.frombuffer(tokens, "<u8")
                yield from dealer.add((mix(token) % np.uint64(buckets)).astype(np.int32), token, np.full(len(token), rep))
        yield from dealer.flush()

    def count(batches):
        token, rep = gathered(batches, ["<u8", "<i8"])
        _, inverse, times = np.unique(token, return_inverse=True, return_counts=True)
        dealer = Dealer(buckets, ["token", "rep", "times"])
        for at in range(0, len(token), FLUSH):
            some = slice(at, at + FLUSH)
            home = (mix(rep[some].astype(np.uint64)) % np.uint64(buckets)).astype(np.int32)
            yield from dealer.add(home, token[some], rep[some], np.minimum(times[inverse[some]], 2**31 - 1).astype(np.int32))
        yield from dealer.flush()

    def rebuild(batches):
        token, rep, times = gathered(batches, ["<u8", "<i8", "<i4"])
        order = np.lexsort((token, times, rep))
        token, rep, times = token[order], rep[order], times[order]
        starts = np.flatnonzero(np.concatenate([[True], rep[1:] != rep[:-1]])) if len(rep) else np.zeros(0, np.int64)
        ends = np.append(starts[1:], len(rep))
        for at in range(0, len(starts), 256):
            some = list(zip(starts[at : at + 256], ends[at : at + 256], strict=True))
            yield pa.RecordBatch.from_arrays(
                # the numbers are only looked at in the prefix
                [pa.array(rep[starts[at : at + 256]]), pa.array([b - a for a, b in some], pa.int64()), pa.array([float(np.minimum(times[a:b], 1 << 20).mean()) for a, b in some], pa.float64()), pa.array([token[a:b].tobytes() for a, b in some], pa.binary()), pa.array([times[a : b - needed(b - a, percent) + 1].tobytes() for a, b in some], pa.binary())],
                names=["rep", "n", "weight", "tokens", "counts"],
            )

    counted = sets.select("rep", "tokens").mapInArrow(tidy(deal), "bucket int, token binary, rep binary").repartitionById(buckets, F.col("bucket")).mapInArrow(tidy(count), "bucket int, token binary, rep binary, times binary")
    return counted.repartitionById(buckets, F.col("bucket")).mapInArrow(tidy(rebuild), "rep long, n long, weight double, tokens binary, counts binary")


def bitmap(tokens: np.ndarray) -> bytes:
    """Parity bitmap: bit h flips for each token that hashes to h. Differing bits are at most differing tokens."""
    size = 4 << max(4, int(len(tokens)).bit_length())  # bits: at least four times the tokens, a power of two
    odd = np.bincount((mix(tokens) % np.uint64(size)).astype(np.int64), minlength=size) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def postings(sets: DataFrame, percent: int) -> DataFrame:
    """token, rep, n, place, times, weight for the prefix tokens that another set has too."""

    def run(batches):
        for batch in batches:
            out = [[], [], [], [], [], []]
            for rep, n, weight, tokens, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                first = n - needed(n, percent) + 1
                token, times = np.frombuffer(tokens, "<u8")[:first], np.frombuffer(counts, "<i4")[:first]
                at = np.flatnonzero(times > 1)
                for c, x in zip(out, (token[at].view(np.int64), np.full(len(at), rep), np.full(len(at), n), at, times[at], np.full(len(at), weight)), strict=True):
                    c.append(x)
            if out[0]:
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.float64()]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), kind) for c, kind in zip(out, kinds, strict=True)], names=["token", "rep", "n", "place", "times", "weight"])

    return sets.select("rep", "n", "weight", "tokens", "counts").mapInArrow(tidy(run), "token long, rep long, n long, place long, times int, weight double")


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Common entries of two sorted arrays of distinct values."""
    if not len(a) or not len(b):
        return 0
    return int(np.count_nonzero(b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a))


def linked(inter: int, a: int, b: int, percent: int) -> bool:
    return 100 * inter >= percent * (a + b - inter)


def with_tokens(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """rep, leader, own_tokens, lead_tokens of pairs (rep, leader); the pairs of one leader are split over tasks."""
    parts = pairs.groupBy(F.col("leader").alias("of_leader")).agg(F.ceil(F.count(F.lit(1)) / F.lit(LED)).cast("int").alias("parts"))
    split = cut(pairs.join(parts, F.col("leader") == F.col("of_leader")).select("rep", "leader", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int").alias("part"), "parts"))
    own = sets.select(F.col("rep").alias("own"), F.col("tokens").alias("own_tokens"))
    wanted = split.select(F.col("leader").alias("led_by"), "parts").distinct()
    lead = sets.select(F.col("rep").alias("lead_rep"), F.col("tokens").alias("lead_tokens")).join(wanted, F.col("lead_rep") == F.col("led_by"))
    lead = lead.select("led_by", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("lead_part"), "lead_tokens")
    rows = split.join(own, F.col("rep") == F.col("own")).join(lead, (F.col("leader") == F.col("led_by")) & (F.col("part") == F.col("lead_part")))
    return rows.select("rep", "leader", "own_tokens", "lead_tokens")


def follow(lists: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """rep, leader, minus, plus: the sets that are linked with their leader, and how they differ from it.

    A set's leader is the one of greatest weight in any of its prefix lists.
    """
    best = F.max(F.struct("weight", (-F.col("rep")).alias("minus_rep"))).alias("best")
    per_list = lists.groupBy(F.col("token").alias("of_token")).agg(best)
    chosen = lists.join(per_list, F.col("token") == F.col("of_token")).groupBy("rep").agg(F.max("best").alias("best"))
    pairs = chosen.select("rep", (-F.col("best.minus_rep")).alias("leader")).where("rep <> leader")

    def run(batches):
        kinds = pa.schema([("rep", pa.int64()), ("leader", pa.int64()), ("minus", pa.binary()), ("plus", pa.binary())])
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                a, b = np.sort(np.frombuffer(r["own_tokens"], "<u8")), np.sort(np.frombuffer(r["lead_tokens"], "<u8"))
                both = np.intersect1d(a, b, assume_unique=True)
                if linked(len(both), len(a), len(b), percent):
                    out.append({"rep": r["rep"], "leader": r["leader"], "minus": np.setdiff1d(b, both, True).tobytes(), "plus": np.setdiff1d(a, both, True).tobytes()})
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=kinds)

    return with_tokens(pairs, sets).mapInArrow(tidy(run), "rep long, leader long, minus binary, plus binary")


def still_open(lists: DataFrame, component: DataFrame) -> DataFrame:
    """token, rep, n, place, component, entries: the lists whose sets are in more than one component."""
    placed = lists.join(component.select(F.col("rep").alias("of_rep"), F.col("component").alias("known")), F.col("rep") == F.col("of_rep"), "left").select("token", "rep", "n", "place", F.coalesce("known", "rep").alias("component"))
    mixed = placed.groupBy("token").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count(F.lit(1)).alias("entries")).where("low <> high")
    return cut(placed.join(mixed.select(F.col("token").alias("of_token"), "entries"), F.col("token") == F.col("of_token")).drop("of_token"))


def led_links(open_: DataFrame, sets: DataFrame, percent: int, round_: int) -> DataFrame:
    """rep, leader: links of the sets of open lists with their lists' leaders, which differ from round to round."""
    per_list = open_.groupBy("token").agg(F.max(F.struct(F.xxhash64("rep", "token", F.lit(round_)).alias("drawn"), "rep", "n", "component")).alias("lead"))
    met = open_.join(per_list.select(F.col("token").alias("of_token"), "lead"), F.col("token") == F.col("of_token"))
    near = (100 * F.least("n", "lead.n") >= percent * F.greatest("n", "lead.n")) & (F.col("component") != F.col("lead.component"))
    pairs = met.where(near).select("rep", F.col("lead.rep").alias("leader")).distinct()

    def run(batches):
        last, lead = None, None
        for batch in batches:
            reps, leaders, own = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)
            out = []
            for i, leader in enumerate(leaders):
                if leader != last:
                    last, lead = leader, np.sort(np.frombuffer(batch.column(3)[i].as_py(), "<u8"))
                tokens = np.frombuffer(own[i].as_py(), "<u8")
                if linked(overlap(tokens, lead), len(tokens), len(lead), percent):
                    out.append((reps[i], leader))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in out], pa.int64()), pa.array([p[1] for p in out], pa.int64())], names=["rep", "leader"])

    return with_tokens(pairs, sets).sortWithinPartitions("leader").mapInArrow(tidy(run), "rep long, leader long")


def list_pairs(rep, n, place, comp, bits, side, percent: int):
    """Pairs of one block task that may be linked: entries of one list, sorted by set size, in blocks that are skipped whole.

    ``side`` is 0 or 1; with both sides present only pairs across them count.
    """
    order = np.lexsort((rep, n))
    rep, n, place, comp, side = (x[order] for x in (rep, n, place, comp, side))
    bits = [bits[i] for i in order]
    across = side.min() != side.max()
    rest = n - place  # what is left from the common token on, itself included
    edges = np.arange(0, len(rep), SKIP_BLOCK)
    blocks = [slice(e, min(e + SKIP_BLOCK, len(rep))) for e in edges]
    least, most, left = ([f(x[b]) for b in blocks] for f, x in ((np.min, n), (np.max, n), (np.max, rest)))
    alone = [comp[b][0] if (comp[b] == comp[b][0]).all() else None for b in blocks]
    folded: dict[tuple[int, int], np.ndarray] = {}

    def maps(i: int, size: int) -> np.ndarray:
        if (i, size) not in folded:
            rows = []
            for x in bits[blocks[i]]:
                m = np.frombuffer(x, np.uint8)
                # bit positions are hash mod size, so halves fold by XOR
                rows.append(np.bitwise_xor.reduce(m.reshape(-1, size), axis=0))
            folded[i, size] = np.stack(rows)
        return folded[i, size]

    found = []
    for i in range(len(blocks)):
        for j in range(i, len(blocks)):
            if 100 * most[i] < percent * least[j]:
                break  # all further sets are too large
            must = -(-percent * (least[i] + least[j]) // (100 + percent))
            if min(left[i], left[j]) < must or (alone[i] is not None and alone[i] == alone[j]):
                continue
            a, b = blocks[i], blocks[j]
            total = n[a][:, None] + n[b][None, :]
            need = -(-percent * total // (100 + percent))
            ok = (100 * np.minimum(n[a][:, None], n[b][None, :]) >= percent * np.maximum(n[a][:, None], n[b][None, :])) & (np.minimum(rest[a][:, None], rest[b][None, :]) >= need) & (comp[a][:, None] != comp[b][None, :])
            if across:
                ok &= side[a][:, None] != side[b][None, :]
            if i == j:
                ok &= np.triu(np.ones(ok.shape, bool), 1)
            if not ok.any():
                continue
            x, y = np.nonzero(ok)
            size = min(min(len(v) for v in bits[a]), min(len(v) for v in bits[b]))
            differ = np.bitwise_count(maps(i, size)[x] ^ maps(j, size)[y]).sum(axis=1, dtype=np.int64)
            near = differ <= total[x, y] - 2 * need[x, y]
            found.append((rep[a][x[near]], rep[b][y[near]]))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    p, q = (np.concatenate(v) for v in zip(*found, strict=True))
    return np.minimum(p, q), np.maximum(p, q)


def candidates(open_: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """a, b: pairs of sets of different components in open lists that pass all bounds."""

    def add_bits(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([bitmap(np.frombuffer(t, "<u8")) for t in batch.column(1).to_pylist()], pa.binary())], names=["bits_of", "bits"])

    maps = sets.select("rep", "tokens").mapInArrow(tidy(add_bits), "bits_of long, bits binary")
    parts = F.ceil(F.col("entries") / F.lit(LIST_BLOCK)).cast("int")
    tasks = (
        open_.withColumn("parts", parts)
        .withColumn("part", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int"))
        .select("token", "rep", "n", "place", "component", "part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("with_part"))
        .select("token", "rep", "n", "place", "component", F.least("part", "with_part").alias("i"), F.greatest("part", "with_part").alias("j"), (F.col("part") > F.col("with_part")).cast("int").alias("side"))
    )
    rows = tasks.join(maps, F.col("rep") == F.col("bits_of")).select("token", "i", "j", "rep", "n", "place", "component", "bits", "side")
    dealt = rows.repartition(parallelism(sets.sparkSession), "token", "i", "j").sortWithinPartitions("token", "i", "j")

    def run(batches):
        last, held, seen = None, [], set()

        def task():
            part = pa.Table.from_batches(held)
            cols = {c: part[c].to_numpy() for c in ("rep", "n", "place", "component", "side")}
            a, b = list_pairs(cols["rep"], cols["n"], cols["place"], cols["component"], part["bits"].to_pylist(), cols["side"], percent)
            new = [p for p in zip(a.tolist(), b.tolist(), strict=True) if p not in seen]
            if len(seen) > 100_000:  # only spares repeated pairs, which go later anyway
                seen.clear()
            seen.update(new[:100_000])
            return pa.RecordBatch.from_arrays([pa.array([p[0] for p in new], pa.int64()), pa.array([p[1] for p in new], pa.int64())], names=["a", "b"])

        for batch in batches:
            keys = [batch.column(c).to_numpy() for c in range(3)]
            change = np.flatnonzero(np.concatenate([[True], np.logical_or.reduce([k[1:] != k[:-1] for k in keys])])) if batch.num_rows else np.zeros(0, np.int64)
            for a, b in zip(change, np.append(change[1:], batch.num_rows), strict=True):
                key = tuple(k[a] for k in keys)
                if key != last and held:
                    yield task()
                    held = []
                last = key
                held.append(batch.slice(a, b - a))
        if held:
            yield task()

    return dealt.mapInArrow(tidy(run), "a long, b long").distinct()


def links(pairs: DataFrame, sets: DataFrame, followers: DataFrame, percent: int) -> DataFrame:
    """a, b: the candidate pairs that are linked, overlaps derived from those of the leaders."""
    led = pairs.join(followers.select(F.col("rep").alias("of_rep"), "leader", "minus", "plus"), F.col("a") == F.col("of_rep"), "left").select("a", "b", F.coalesce("leader", "a").alias("lead"), "minus", "plus")
    first = sets.select(F.col("rep").alias("lead_rep"), F.col("tokens").alias("lead_tokens"))
    other = sets.select(F.col("rep").alias("other_rep"), F.col("tokens").alias("other_tokens"))
    rows = led.join(first, F.col("lead") == F.col("lead_rep")).join(other, F.col("b") == F.col("other_rep"))
    rows = rows.select("a", "b", "lead", "minus", "plus", "lead_tokens", "other_tokens").sortWithinPartitions("lead", "b")

    def run(batches):
        last, lead, other, shared = None, None, None, 0
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                if last != (r["lead"], r["b"]):
                    last = r["lead"], r["b"]
                    lead, other = np.sort(np.frombuffer(r["lead_tokens"], "<u8")), np.sort(np.frombuffer(r["other_tokens"], "<u8"))
                    shared = overlap(lead, other)
                minus, plus = (np.frombuffer(r[c] or b"", "<u8") for c in ("minus", "plus"))
                inter = shared - overlap(minus, other) + overlap(plus, other)
                if linked(inter, len(lead) - len(minus) + len(plus), len(other), percent):
                    out.append((r["a"], r["b"]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in out], pa.int64()), pa.array([p[1] for p in out], pa.int64())], names=["a", "b"])

    return rows.mapInArrow(tidy(run), "a long, b long")


def stars_of(edges: DataFrame) -> DataFrame:
    """rep, component of all sets of the links ``edges`` (rep, leader)."""
    return cut(graph.components(edges.select(F.col("rep").alias("a"), F.col("leader").alias("b"))).select(F.col("node").alias("rep"), "component"))


def families(docs: DataFrame, k: int, percent: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``signature, rep, first_doc, copies, component`` of each set that may have a partner; the sets; the followers."""
    alive = cut(few_files(maybe_linked(docs, k, percent)))
    if alive.count() <= SMALL_IDS:  # then no text needs to be shuffled
        alive = F.broadcast(alive)
    # equal sets are one, whatever their number; a set's own number is a hash of its name
    grouped = whole_sets(docs.join(alive, "doc_id", "left_semi"), k).groupBy("signature").agg(F.min("doc_id").alias("first_doc"), F.any_value("tokens").alias("tokens"), F.count(F.lit(1)).alias("copies"))
    same = cut(grouped.withColumn("rep", F.xxhash64("signature")))
    sets = cut(ordered(same, percent))
    lists = cut(postings(sets, percent))
    followers = cut(follow(lists, sets, percent))
    stars = stars_of(followers)
    lists = lists.select("token", "rep", "n", "place")
    open_ = still_open(lists, stars)
    entries = square = None
    for round_ in range(ROUNDS):
        before, (entries, square) = entries, open_.select(F.count(F.lit(1)), F.sum("entries")).collect()[0]
        # lists are short, or leaders no longer join much: the rest is compared pair by pair
        if not entries or square <= SHORT * entries or (round_ and entries > 0.9 * before):
            break
        met = cut(led_links(open_, sets, percent, round_))
        stars = stars_of(stars.select("rep", F.col("component").alias("leader")).unionAll(met))
        open_ = still_open(open_.select("token", "rep", "n", "place"), stars)
    found = links(candidates(open_, sets, percent), sets, followers, percent)
    whole = graph.components(stars.select(F.col("rep").alias("a"), F.col("component").alias("b")).unionAll(found))
    classes = same.join(whole, F.col("rep") == F.col("node"), "left").select("signature", "rep", "first_doc", "copies", F.coalesce("component", "rep").alias("component"))
    return cut(classes), sets, followers


def named(classes: DataFrame) -> DataFrame:
    """``classes`` with ``component_id``, the smallest id of each component."""
    least = classes.groupBy(F.col("component").alias("of_component")).agg(F.min("first_doc").alias("component_id"))
    return classes.join(cut(least), F.col("component") == F.col("of_component")).drop("of_component")


def class_of_signature(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """``signature, component_id``: the smallest id reachable from each set that may have a partner."""
    return named(families(docs, k, percent)[0]).select("signature", "component_id")


def overlaps(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Common entries of each of ``a`` and each of ``b``, by products of membership matrices over ranges of tokens."""
    sizes = [len(x) for x in (*a, *b)]
    tokens, column, times = np.unique(np.concatenate([*a, *b]), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(sizes)), sizes)
    several = times[column] > 1
    column, row = (np.cumsum(times > 1) - 1)[column[several]], row[several]
    order = np.argsort(column, kind="stable")
    column, row = column[order], row[order]
    made = np.zeros((len(a), len(b)))
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, TOKENS):
        lo, hi = np.searchsorted(column, [at, at + TOKENS])
        has = np.zeros((len(sizes), min(TOKENS, int(column[-1]) + 1 - at)), np.float32)
        has[row[lo:hi], column[lo:hi] - at] = 1
        made += has[: len(a)] @ has[len(a) :].T
    return made.astype(np.int64)


def are_linked(a: list[np.ndarray], b: list[np.ndarray], percent: int) -> np.ndarray:
    inter = overlaps(a, b)
    either = np.array([len(x) for x in a])[:, None] + np.array([len(x) for x in b])[None, :] - inter
    return (100 * inter >= percent * either).astype(np.int64)


def laid(arrays: list[np.ndarray]) -> dict:
    return {"data": np.concatenate(arrays).tobytes() if arrays else b"", "sizes": [len(x) for x in arrays]}


def taken(packed: dict) -> list[np.ndarray]:
    return np.split(np.frombuffer(packed["data"], "<u8"), np.cumsum(packed["sizes"])[:-1])


def members_of(tile: dict) -> list[np.ndarray]:
    """The whole sets of a tile: its leaders', less what each member lacks, plus what it adds."""
    leads = taken(tile["leads"])
    return [np.concatenate([np.setdiff1d(leads[i], less, True), more]) for i, less, more in zip(tile["led"], taken(tile["minus"]), taken(tile["plus"]), strict=True)]


def runs_of(batches, keys: int):
    """Lists of rows that are neighbours and equal in their first ``keys`` columns."""
    last, held = None, []
    for batch in batches:
        for row in batch.to_pylist():
            key = tuple(row.values())[:keys]
            if key != last and held:
                yield held
                held = []
            last = key
            held.append(row)
    if held:
        yield held


def links_within(classes: DataFrame, sets: DataFrame, followers: DataFrame, percent: int) -> DataFrame:
    """rep, n: how many rows of other sets each set is linked with, for sets that have any.

    Links join sets of one component only. A component's sets are dealt to tiles
    and every pair of tiles is compared; tiles hold the leaders' tokens and the
    differences from them, and give sums by set, no pairs.
    """
    sizes = cut(classes.groupBy(F.col("component").alias("of_component")).agg(F.ceil(F.count(F.lit(1)) / F.lit(TILE)).cast("int").alias("parts"), F.count(F.lit(1)).alias("many")).where("many > 1").drop("many"))
    differ = followers.select(F.col("rep").alias("of_rep"), "leader", "minus", "plus")
    tiled = classes.join(sizes, F.col("component") == F.col("of_component")).select("component", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int").alias("tile"), "parts", "rep", "copies")
    members = cut(tiled.join(differ, F.col("rep") == F.col("of_rep"), "left").select("component", "tile", "parts", F.coalesce("leader", "rep").alias("home"), "rep", "copies", "minus", "plus"))
    leads = members.select("component", "tile", "parts", "home").distinct().join(sets.select(F.col("rep").alias("lead_rep"), F.col("tokens").alias("plus")), F.col("home") == F.col("lead_rep"))
    no = F.lit(None)
    rows = members.unionByName(leads.select("component", "tile", "parts", "home", no.cast("long").alias("rep"), no.cast("long").alias("copies"), no.cast("binary").alias("minus"), "plus"))
    dealt = rows.repartition(parallelism(sets.sparkSession), "component", "tile").sortWithinPartitions("component", "tile")
    packed = "struct<data:binary,sizes:array<int>>"
    tile_schema = f"component long, tile int, parts int, reps array<long>, copies array<long>, sums array<long>, led array<int>, leads {packed}, minus {packed}, plus {packed}"
    pack_ = pa.struct([("data", pa.binary()), ("sizes", pa.list_(pa.int32()))])
    longs = pa.list_(pa.int64())
    tile_kinds = pa.schema([("component", pa.int64()), ("tile", pa.int32()), ("parts", pa.int32()), ("reps", longs), ("copies", longs), ("sums", longs), ("led", pa.list_(pa.int32())), ("leads", pack_), ("minus", pack_), ("plus", pack_)])

    def pack(batches):
        for held in runs_of(batches, 2):
            token = {r["home"]: np.frombuffer(r["plus"], "<u8") for r in held if r["rep"] is None}
            own = [r for r in held if r["rep"] is not None]
            place = {home: i for i, home in enumerate(token)}
            some = {c: laid([np.frombuffer(r[c] or b"", "<u8") for r in own]) for c in ("minus", "plus")}
            tile = {c: held[0][c] for c in ("component", "tile", "parts")} | some | {"reps": [r["rep"] for r in own], "copies": [r["copies"] for r in own], "led": [place[r["home"]] for r in own], "leads": laid(list(token.values()))}
            whole = members_of(tile)
            near = are_linked(whole, whole, percent)
            np.fill_diagonal(near, 0)
            tile["sums"] = (near @ np.array(tile["copies"])).tolist()
            if tile["parts"] == 1:  # no other tile to be compared with
                tile |= dict.fromkeys(("copies", "led", "leads", "minus", "plus"))
            yield pa.RecordBatch.from_pylist([tile], schema=tile_kinds)

    tiles = cut(dealt.mapInArrow(tidy(pack), tile_schema))
    others = tiles.where("parts > 1").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).where("other <> tile")
    met = others.select("component", F.least("tile", "other").alias("i"), F.greatest("tile", "other").alias("j"), "reps", "copies", "led", "leads", "minus", "plus")
    met = met.repartition(parallelism(sets.sparkSession), "component", "i", "j").sortWithinPartitions("component", "i", "j")

    def compare(batches):
        for two in runs_of(batches, 3):
            if len(two) < 2:  # a tile that no set was dealt to
                continue
            near = are_linked(*map(members_of, two), percent)
            sums = near @ np.array(two[1]["copies"]), near.T @ np.array(two[0]["copies"])
            yield pa.RecordBatch.from_arrays([pa.array([x["reps"] for x in two], longs), pa.array([x.tolist() for x in sums], longs)], names=["reps", "sums"])

    parts = tiles.select("reps", "sums").unionAll(met.mapInArrow(tidy(compare), "reps array<long>, sums array<long>"))
    one = parts.select(F.explode(F.arrays_zip("reps", "sums")).alias("x")).select(F.col("x.reps").alias("rep"), F.col("x.sums").alias("n"))
    return one.where("n > 0").groupBy("rep").agg(F.sum("n").alias("n"))


def jaccard_links(df: DataFrame, k: int = 4, percent: int = 85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """:func:`jaccard_join` with ``n_links``: with how many other rows each row is linked, copies and links inside a family included.

    Rows without words or with a null id have 0.
    """
    docs = texts(df, id_col, text_col)
    classes, sets, followers = families(docs, k, percent)
    linked_rows = cut(links_within(classes, sets, followers, percent)).withColumnRenamed("rep", "of_rep")
    known = named(classes).join(linked_rows, F.col("rep") == F.col("of_rep"), "left")
    known = cut(known.select(F.col("signature").alias("of_signature"), "component_id", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links")))
    every = signed(docs, k).join(known, F.col("signature") == F.col("of_signature"), "left")
    valid = F.col("doc_id").isNotNull()
    return every.select("doc_id", "n_shingles", F.when(valid, F.coalesce("component_id", "doc_id")).alias("component_id"), F.when(valid, F.coalesce("n_links", F.lit(0))).otherwise(0).alias("n_links"))


def jaccard_join(df: DataFrame, k: int = 4, percent: int = 85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id`` for every row of ``df``.

    Words are runs of anything but ASCII white space, with A-Z lower-cased; a
    row's set is its distinct ``k``-word shingles, or all its words as one if
    they are fewer. Two rows link when their sets' intersection is at least
    ``percent`` percent of their union; rows without words (null and empty texts
    too) link with nothing and are their own component, equal sets always link.
    The component is the smallest id reachable. Rows that share an id stand each
    for their own text. Rows with a null id link with nothing and have a null
    component. An empty table gives no rows; other columns are ignored.
    """
    docs = texts(df, id_col, text_col)
    classes = class_of_signature(docs, k, percent).withColumnRenamed("signature", "of_signature")
    every = signed(docs, k).join(classes, F.col("signature") == F.col("of_signature"), "left")
    return every.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))


def one_of_each(df: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``df`` without the rows that another one of their component, of a smaller id, stands for.

    Rows of one id stay or go together; rows with a null id and rows without words stay.
    """
    gone = jaccard_join(df, k, percent, id_col, text_col).where("doc_id <> component_id").select(F.col("doc_id").alias("stood_for")).distinct()
    rows = positional(df)
    return rows.join(gone, F.col(f"c{place_of(df, id_col)}").cast("long") == F.col("stood_for"), "left_anti").toDF(*df.columns)
