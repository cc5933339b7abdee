"""Near-duplicate records with small edits (problem 2).

Order MinHash. A text's words are read as occurrence-labelled k-mers; each of ``sketches`` hash orders samples the
``sampled`` smallest of them and keeps them in text order. Texts that agree in a sample, its order included, are
candidates. Of pairs at the limit about one in a hundred shares no sample (README has the measured recall); block moves
cost only the samples that lie in two of the moved blocks.

Candidates are sifted by an odd sketch: every word flips one of 512 bits, so the bits that differ never outnumber the
words that differ. The bound is exact: no pair over the limit is lost to it; nor is any to the histogram bound that
follows on the words themselves. What is left is verified by a banded alignment (shared words on the band already decide
most pairs) and, because the limit of problem 2 sets word order aside, by the exact bag of words where that does not
suffice.

Texts with the same bag of words are one class; only the class's first row enters the candidate search, so a group of
copies costs one row there however large it is. A sample that more than ``HOT`` classes have is dealt to blocks, so no task
meets all pairs of a hot sample; all of them are still met.

Samples that only one row has, most of them, meet nothing: they are told by ids and samples alone and go before anything
else is shuffled. Rows meet with the odd sketch folded to ``FOLDED`` words (which bounds as exactly, if less closely), so what it rules out
ends in the join: pairs that merely share a sample, which grow with the square of a hot one, are never written or
shuffled. The orders take turns, a few of them at a time, and scratch tables and shuffle files go when they have been
read, so the disk holds one turn's rows.

Texts of fewer than ``least`` words, null or empty ones among them, have no pairs. Rows with a null key are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltworks.llm import words as W
from siltworks.session import dropped, released, small, stored

K, SAMPLED, SKETCHES, SEED = 4, 2, 32, 23
LEAST = 20
#: Half width of the alignment's band, in words.
BAND = 16
#: ``num`` * shared >= ``den`` * total.
NUM, DEN = 10, 7
#: Rows of a sample that are joined in one block.
HOT = 16384
#: Orders that take a turn, more where that makes fewer than ``TURN_ROWS`` rows; words of the odd sketch that a sample's rows carry.
TURN, TURN_ROWS, FOLDED = 4, 1_000_000, 4
#: Columns of the odd sketch, 64 bits each.
SKETCH = [f"s{j}" for j in range(8)]


def labelled(v: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Hashes of flat values with their occurrence number within the row."""
    key = W.mix(v ^ W.mix(row.astype(np.uint64) + np.uint64(7)))
    order = np.argsort(key, kind="stable")
    s = key[order]
    first = np.ones(len(s), bool)
    first[1:] = s[1:] != s[:-1]
    start = np.maximum.accumulate(np.where(first, np.arange(len(s)), 0))
    nth = np.empty(len(s), np.uint64)
    nth[order] = (np.arange(len(s)) - start).astype(np.uint64)
    return np.where(nth == 0, v, W.mix(v + nth * np.uint64(0x9E3779B97F4A7C15)))


def samples(h: np.ndarray, off: np.ndarray, sketches: int = SKETCHES, sampled: int = SAMPLED, k: int = K, ordered: bool = True) -> np.ndarray:
    """(texts, sketches) keys of the sampled k-mers of each text, in text order or (``ordered`` false) by size; h, off: flat word hashes and offsets."""
    lens = np.diff(off)
    row = np.repeat(np.arange(len(lens)), lens)
    g = W.shingles(h, k)
    last = np.full(len(h), np.iinfo(np.uint64).max, np.uint64)
    if len(g):
        inside = row[: len(g)] == row[k - 1 :]
        at = np.flatnonzero(inside)
        last[at] = labelled(g[at], row[at])
    out = np.zeros((len(lens), sketches), np.uint64)
    mult = W.multipliers(sketches, SEED)[:, None, None]
    by_length = np.argsort(lens, kind="stable")
    lo = 0
    while lo < len(lens):
        own = by_length[lo : lo + 128]
        own = own[: max(1, 32_768 // max(1, int(lens[own[-1]])))]  # few long texts at a time
        lo += len(own)
        width = max(int(lens[own[-1]]) - k + 1, sampled)
        place = off[own][:, None] + np.arange(width)[None, :]
        real = np.arange(width)[None, :] < (lens[own] - k + 1)[:, None]
        m = np.where(real, last[np.minimum(place, max(0, len(h) - 1))], np.iinfo(np.uint64).max)
        p = m[None] * mult
        p[:, ~real] = np.iinfo(np.uint64).max
        where = np.zeros((*p.shape[:2], sampled), np.int64)
        low = np.zeros(where.shape, np.uint64)
        for j in range(sampled):
            at = p.argmin(axis=2)[:, :, None]
            where[:, :, j : j + 1], low[:, :, j : j + 1] = at, np.take_along_axis(p, at, axis=2)
            np.put_along_axis(p, at, np.iinfo(np.uint64).max, axis=2)
        if ordered:
            low = np.take_along_axis(low, where.argsort(axis=2, kind="stable"), axis=2)
        key = np.zeros(low.shape[:2], np.uint64)
        for j in range(sampled):
            key = W.mix(key * np.uint64(31) + low[:, :, j])
        out[own] = W.mix(key + np.arange(sketches, dtype=np.uint64)[:, None]).T
    return out


def odd_bits(h: np.ndarray, off: np.ndarray, bits: int = 64 * len(SKETCH)) -> np.ndarray:
    """(texts, bits / 64) words of the odd sketch: bit i is the parity of the words that hash to i."""
    out = np.zeros((len(off) - 1, bits // 64), np.uint64)
    spot = (W.mix(h ^ np.uint64(0x5851F42D4C957F2D)) & np.uint64(bits - 1)).astype(np.int64)
    for lo in range(0, len(out), 2048):
        o = off[lo : lo + 2049]
        row = np.repeat(np.arange(len(o) - 1), np.diff(o))
        n = np.bincount(row * bits + spot[o[0] : o[-1]], minlength=(len(o) - 1) * bits).reshape(-1, bits) & 1
        out[lo : lo + 2048] = np.packbits(n.astype(np.uint8), axis=1, bitorder="little").view(np.uint64)
    return out


def bag_hashes(h: np.ndarray, off: np.ndarray) -> np.ndarray:
    """(texts, 2) order-free hashes of the bag of words."""
    out = np.zeros((len(off) - 1, 2), np.uint64)
    for j, salt in enumerate((0x2545F4914F6CDD1D, 0x14057B7EF767814F)):
        c = np.concatenate([np.zeros(1, np.uint64), np.cumsum(W.mix(h ^ np.uint64(salt)), dtype=np.uint64)])
        out[:, j] = W.mix(c[off[1:]] - c[off[:-1]])
    return out


def _signed(a: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(a).view(np.int64))


def sketched(df: DataFrame, key: str, text: str, least: int = LEAST, sketches: int = SKETCHES) -> DataFrame:
    """(id, n, b0, b1, s0..s7, keys) of the rows of at least ``least`` words; keys: 32 bits of the sample of each order, a clash costs a candidate."""

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h, off = W.ragged(b.column(1))
            bag, odd, keys = bag_hashes(h, off), odd_bits(h, off), samples(h, off, sketches)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, sketches, dtype=np.int32)), pa.array((keys.reshape(-1) >> np.uint64(32)).astype(np.uint32).view(np.int32)))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(np.diff(off).astype(np.int32)), *(_signed(bag[:, j]) for j in range(2)), *(_signed(odd[:, j]) for j in range(len(SKETCH))), lists],
                names=["id", "n", "b0", "b1", *SKETCH, "keys"],
            )

    src = df.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("id"), W.word_hashes(F.col(text)).alias("h")).where(F.size("h") >= least)
    return src.mapInArrow(over, f"id long, n int, b0 long, b1 long, {', '.join(f'{x} long' for x in SKETCH)}, keys array<int>")


def possible(a: str, b: str, sketch: list[str] = SKETCH) -> Column:
    """Whether two sketches can belong to texts over the limit: by length and by the bits that differ."""
    na, nb = F.col(f"{a}.n"), F.col(f"{b}.n")
    apart = sum((F.bit_count(F.col(f"{a}.{s}").bitwiseXOR(F.col(f"{b}.{s}"))) for s in sketch), F.lit(0))
    # shared >= den (na + nb) / (num + den), so at most (num - den)(na + nb) / (num + den) words differ
    return (NUM * F.least(na, nb) >= DEN * F.greatest(na, nb)) & ((NUM + DEN) * apart <= (NUM - DEN) * (na + nb))


def shared_words(ha: np.ndarray, oa: np.ndarray, hb: np.ndarray, ob: np.ndarray) -> np.ndarray:
    """For each pair of texts the words they share, counted with repetition."""
    out = np.zeros(len(oa) - 1, np.int64)
    for lo in range(0, len(out), 2048):
        hi = min(lo + 2048, len(out))
        rows, keys = [np.repeat(np.arange(hi - lo, dtype=np.uint64), np.diff(o[lo : hi + 1])) for o in (oa, ob)], []
        for side, (h, o, r) in enumerate(((ha, oa, rows[0]), (hb, ob, rows[1]))):
            # pair, 52 bits of the word, side: a plain sort puts the same words of a pair together
            keys.append((r << np.uint64(53)) | (W.mix(h[o[lo] : o[hi]]) >> np.uint64(12) << np.uint64(1)) | np.uint64(side))
        both = np.sort(np.concatenate(keys))
        if not len(both):
            continue
        word = both >> np.uint64(1)
        first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
        more = np.abs(np.add.reduceat(1 - 2 * (both & np.uint64(1)).astype(np.int64), first))
        apart = np.bincount((both[first] >> np.uint64(53)).astype(np.int64), more, minlength=hi - lo).astype(np.int64)
        out[lo:hi] = (np.diff(oa[lo : hi + 1]) + np.diff(ob[lo : hi + 1]) - apart) // 2
    return out


def least_apart(ha: np.ndarray, oa: np.ndarray, hb: np.ndarray, ob: np.ndarray, bins: int = 512) -> np.ndarray:
    """For each pair of texts a lower bound of the words that differ: the distance of their hashed word histograms."""
    n = len(oa) - 1
    spot = [np.repeat(np.arange(n) * bins, np.diff(o)) + (W.mix(h) & np.uint64(bins - 1)).astype(np.int64) for h, o in ((ha, oa), (hb, ob))]
    return np.abs(np.bincount(spot[0], minlength=n * bins) - np.bincount(spot[1], minlength=n * bins)).reshape(n, bins).sum(axis=1)


def aligned_words(ha: np.ndarray, oa: np.ndarray, hb: np.ndarray, ob: np.ndarray, band: int = BAND) -> np.ndarray:
    """For each pair the words matched by the best alignment within a band around the line through their shared k-mers."""
    n = len(oa) - 1
    la, lb = np.diff(oa), np.diff(ob)
    out = np.zeros(n, np.int64)
    by_length = np.argsort(la, kind="stable")
    for lo in range(0, n, 512):
        own = by_length[lo : lo + 512]
        wa, wb = int(la[own].max(initial=1)), int(lb[own].max(initial=1))
        a = np.zeros((len(own), wa), np.uint64)
        b = np.zeros((len(own), wb + 2 * (wa + wb + band) + 2), np.uint64)
        shift = np.zeros(len(own), np.int64)
        pad = wa + wb + band
        for i, p in enumerate(own):
            x, y = ha[oa[p] : oa[p + 1]], hb[ob[p] : ob[p + 1]]
            a[i, : len(x)] = x | np.uint64(1)
            b[i, pad : pad + len(y)] = y | np.uint64(1)
            gx, gy = W.shingles(x, K), W.shingles(y, K)
            _, ix, iy = np.intersect1d(gx, gy, return_indices=True)
            shift[i] = int(np.median(iy - ix)) if len(ix) else 0
        lcs = np.zeros((len(own), 2 * band + 1), np.int32)
        rows = np.arange(len(own))[:, None]
        cols = pad + shift[:, None] + np.arange(-band, band + 1)[None, :]
        cols = np.clip(cols, 0, b.shape[1] - wa - 1)
        for i in range(wa):
            same = (b[rows, cols + i] == a[:, i, None]) & (a[:, i, None] != 0)
            up = np.zeros_like(lcs)
            up[:, :-1] = lcs[:, 1:]
            lcs = np.maximum.accumulate(np.maximum(lcs + same, up), axis=1)
        out[own] = lcs.max(axis=1)
    return out


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """(a, b, shared, total) of the candidate pairs over the limit. texts: (id, h), the word hashes of all their rows."""

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 2048):
                b = whole.slice(lo, 2048)
                ha, oa = W.ragged(b.column(2))
                hb, ob = W.ragged(b.column(3))
                n = np.diff(oa) + np.diff(ob)
                b = b.take(pa.array(np.flatnonzero((NUM + DEN) * least_apart(ha, oa, hb, ob) <= (NUM - DEN) * n)))
                ha, oa = W.ragged(b.column(2))
                hb, ob = W.ragged(b.column(3))
                n = np.diff(oa) + np.diff(ob)
                shared = aligned_words(ha, oa, hb, ob)
                rest = np.flatnonzero(NUM * shared < DEN * (n - shared))
                if len(rest):
                    pick = b.take(pa.array(rest))
                    shared[rest] = shared_words(*W.ragged(pick.column(2)), *W.ragged(pick.column(3)))
                ok = NUM * shared >= DEN * (n - shared)
                at = pa.array(np.flatnonzero(ok))
                yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at)], names=["a", "b"])

    x = texts.select(F.col("id").alias("a"), F.col("h").alias("ha"))
    y = texts.select(F.col("id").alias("b"), F.col("h").alias("hb"))
    return pairs.join(x, "a").join(y, "b").select("a", "b", "ha", "hb").mapInArrow(over, "a long, b long")


def texts_of(df: DataFrame, key: str, text: str, ids: DataFrame) -> DataFrame:
    """(id, h) of the rows whose id is in ``ids``, a stored table."""
    own = df.select(F.col(key).cast("long").alias("id"), F.col(text).alias("_t")).join(small(ids, 24), "id", "left_semi")
    return own.select("id", W.word_hashes(F.col("_t")).alias("h"))


def folded() -> list[Column]:
    """f0..f3: the odd sketch folded to ``FOLDED`` words; a bit is the parity of all words that hash to one of the bits folded together."""
    return [reduce(lambda x, y: x.bitwiseXOR(y), (F.col(s) for s in SKETCH[j::FOLDED])).alias(f"f{j}") for j in range(FOLDED)]


def _shared(reps: DataFrame, lo: int, turn: int) -> DataFrame:
    """(id, key, parts), as a stored table: the samples of ``turn`` orders that several rows have, and how many parts of ``HOT`` rows those make."""
    rows = reps.select("id", F.posexplode(F.slice("keys", lo + 1, turn)).alias("at", "key"))
    key = F.shiftleft((F.col("at") + lo).cast("long"), 32).bitwiseOR(F.col("key").cast("long").bitwiseAND(F.lit(0xFFFFFFFF)))
    rows = rows.select("id", key.alias("key")).withColumn("c", F.count("*").over(Window.partitionBy("key"))).where(F.col("c") > 1)
    return stored(rows.select("id", "key", F.ceil(F.col("c") / HOT).cast("int").alias("parts")), "near-shared")


def _met(rows: DataFrame) -> DataFrame:
    """(a, b), a < b, of the rows (key, parts, id, n, f0..f3) that have a key in common and can be alike by the folded sketch.

    The rows of a hot key are dealt to parts by the hash of their ids; every two parts are a block, so a row goes to as many
    blocks as there are parts. Rows of the same part meet in that part's ``own`` block only. Both sides of the join have the
    same columns and conditions, so Spark shuffles the rows once and reads them for both.
    """
    dealt = rows.withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    dealt = dealt.withColumn("block", F.least("part", "other") * F.col("parts") + F.greatest("part", "other")).withColumn("own", F.col("part") == F.col("other")).drop("parts", "other")
    l, r = dealt.alias("l"), dealt.alias("r")
    meet = (F.col("l.key") == F.col("r.key")) & (F.col("l.block") == F.col("r.block")) & (F.col("l.id") < F.col("r.id"))
    like = possible("l", "r", [f"f{j}" for j in range(FOLDED)]) & ((F.col("l.own") & F.col("r.own")) | (F.col("l.part") != F.col("r.part")))
    return l.join(r, meet & like).select(F.col("l.id").alias("a"), F.col("r.id").alias("b")).distinct()


def _candidates(reps: DataFrame, sketches: int) -> DataFrame:
    """(a, b), a < b, of the rows (id, n, s0..s7, keys) that agree in a sample and can be alike, as a stored table."""
    several, met, turn = [], [], min(sketches, max(TURN, TURN_ROWS // max(1, reps.count())))
    for lo in range(0, sketches, turn):
        several.append(_shared(reps, lo, turn))
        released(reps.sparkSession)
    brief = reps.select("id", "n", *folded())
    step = max(1, TURN_ROWS * len(several) // max(1, reduce(DataFrame.unionByName, several).count()))
    for lo in range(0, len(several), step):
        own = several[lo : lo + step]
        met.append(stored(_met(reduce(DataFrame.unionByName, own).join(small(brief, 60), "id")), "near-met"))
        dropped(*own)
        released(reps.sparkSession)
    own = reps.select("id", "n", *SKETCH)
    x, y = own.withColumnRenamed("id", "a").alias("x"), own.withColumnRenamed("id", "b").alias("y")
    both = reduce(DataFrame.unionByName, met).distinct()
    out = stored(both.join(small(x, 100), "a").join(small(y, 100), "b").where(possible("x", "y")).select("a", "b"), "near-candidates")
    dropped(*met)
    return out


def near_pairs(df: DataFrame, key: str, text: str, least: int = LEAST, sketches: int = SKETCHES) -> tuple[DataFrame, DataFrame]:
    """Two stored tables: (a, b), a < b, the pairs of class representatives over the limit; (rep, id), the rows of classes of several."""
    sk = stored(sketched(df, key, text, least, sketches), "order-sketches")
    many = stored(sk.groupBy("b0", "b1").agg(F.min("id").alias("rep"), F.count("*").alias("rows")).where("rows > 1"), "copy-classes")
    members = stored(sk.select("id", "b0", "b1").join(small(many.select("b0", "b1", "rep")), ["b0", "b1"]).select("rep", "id"), "copy-members")
    reps = stored(sk.drop("b0", "b1").join(small(members.where("rep <> id").select("id"), 24), "id", "left_anti"), "order-reps")
    dropped(sk, many)
    cand = _candidates(reps, sketches)
    dropped(reps)
    ids = stored(cand.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "near-ids")
    texts = stored(texts_of(df, key, text, ids), "near-texts")
    out = stored(verified(cand, texts), "near-pairs")
    dropped(texts, ids, cand)
    released(df.sparkSession)
    return out, members


def all_pairs(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """(key_a, key_b), key_a < key_b: the pairs of rows that the pairs of representatives and the classes stand for."""
    m = small(members, 32)
    a = pairs.join(m.select(F.col("rep").alias("a"), F.col("id").alias("ia")), "a", "left").withColumn("ia", F.coalesce("ia", "a"))
    ab = a.join(m.select(F.col("rep").alias("b"), F.col("id").alias("ib")), "b", "left").withColumn("ib", F.coalesce("ib", "b"))
    across = ab.select(F.least("ia", "ib").alias("key_a"), F.greatest("ia", "ib").alias("key_b"))
    x, y = members.select("rep", F.col("id").alias("key_a")), members.select("rep", F.col("id").alias("key_b"))
    return across.unionByName(x.join(y, "rep").where("key_a < key_b").select("key_a", "key_b"))


def groups(df: DataFrame, key: str, text: str, least: int = LEAST) -> DataFrame:
    """One row for each row of ``df`` that has a near-duplicate: (``key``, group_id, links).

    ``group_id`` is the smallest key that can be reached over pairs; ``links`` counts the linked classes and copies.
    """
    pairs, members = near_pairs(df, key, text, least)
    edges = pairs.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(members.where("rep <> id").select(F.col("rep").alias("u"), F.col("id").alias("v")))
    both = stored(edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))), "near-edges")
    label = stored(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("g")), "near-labels")
    while True:
        near = both.join(label.select(F.col("u").alias("v"), F.col("g").alias("gv")), "v").groupBy("u").agg(F.min("gv").alias("gv"))
        step = label.join(near, "u").select("u", F.least("g", "gv").alias("to"), "g")
        jump = step.join(label.select(F.col("u").alias("to"), F.col("g").alias("far")), "to", "left")
        new = stored(jump.select("u", F.least(F.col("to"), F.coalesce("far", "to")).alias("g"), (F.least(F.col("to"), F.coalesce("far", "to")) < F.col("g")).alias("moved")), "near-labels")
        label = new.select("u", "g")
        if new.where("moved").isEmpty():
            break
    links = both.groupBy("u").agg(F.count("*").alias("links"))
    return label.join(links, "u").select(F.col("u").alias(key), F.col("g").alias("group_id"), "links")
