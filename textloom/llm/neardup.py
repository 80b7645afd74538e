"""Near duplicates of word shingles by an LSH forest, every link confirmed on full sets.

Documents of equal shingle sets are one class. Each class has a MinHash signature of
``SLOTS`` values; a tree of the forest is the order of all signatures read from another
slot on. Classes whose signatures share a prefix of that order are neighbours. How long
the prefix must be adapts to the region: two values where few share them, more where a
common passage makes a region dense, until no region has more than ``REGION`` members.

Inside a region a task compares one byte of every slot and hands on the pairs that can
reach the limit: 4.2 standard deviations below it. A class with very many such partners
hands on its nearest ones first; the rest of its region is compared once more when
the components are known, if it lies in more than one. There each class brings the
``SKETCH`` smallest hashes of its set, which for most sets is all of them, so that only
pairs that are links or, of larger sets, 4.2 standard deviations below the limit are
handed on. All of them are confirmed too. No pair is left out for the size of its group.

A longer prefix than the first misses pairs at the limit. So the classes of regions that are
full at the first depth, the dense ones, are matched a second way that misses none for their
number. Their shingles are ordered by how many dense classes have them, rarest first. Two
sets as similar as the limit share one of the first ``size - 0.75 size + 1`` of each. Pairs
that share one of at most ``FEW`` classes are a region of their own. Those that only meet in a
more frequent one are compared when the components are known, block by block and only across
components, whatever the number of its classes.

Defined cases: null or empty texts and texts of white space have an empty set and link
with nothing; texts of fewer than ``WORDS`` words are one shingle; equal rows are one
class (classes are named by 64 bits of a hash of their set); a null id has no component, links nothing and is kept; rows with equal ids and
different texts are compared each by its text; an empty table gives an empty result.
Other columns are not carried over.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm.columns import as_text, marked, row_key
from textloom.llm.components import components
from textloom.plans.workdir import materialize, ship_package

WORDS = 5
SIMILARITY = (75, 100)
SLOTS = 96
TREES = 16
DEPTHS = (2, 4, 6, 12, 24, 96)
FEW = 50             # classes of a shingle that are compared before the components are known
REGION = 1000
NEAREST = 4          # partners that a class hands on before the components are known
BLOCK_BYTES = 1 << 19  # of texts whose shingles are counted together
SKETCH = 512         # smallest hashes that a class brings when its region is seen again
DEVIATIONS = 4.2
KEPT_WORDS = 400_000
KEPT_HASHES = 1 << 21


class Shingler:
    """64-bit hashes of words, remembered up to a bound, and of runs of words."""

    def __init__(self):
        self.known: dict[bytes, int] = {}
        self.factors = np.array([pow(0x9E3779B97F4A7C15, k + 1, 1 << 64) | 1 for k in range(WORDS)], np.uint64)

    def hashes(self, text: str) -> np.ndarray:
        """The sorted distinct shingles of a text."""
        words = text.encode().lower().split()
        if not words:
            return np.zeros(0, np.uint64)
        if len(words) < WORDS:
            return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=len(words))], np.uint64)
        known = self.known
        if len(known) > KEPT_WORDS:
            known.clear()
        for w in words:
            if w not in known:
                known[w] = xxhash.xxh3_64_intdigest(w)
        h = np.array([known[w] for w in words], np.uint64)
        n = len(h) - WORDS + 1
        out = np.zeros(n, np.uint64)
        for k in range(WORDS):
            out += h[k:k + n] * self.factors[k]
            out ^= out >> np.uint64(29)
        out *= np.uint64(0xBF58476D1CE4E5B9)
        return np.unique(out ^ (out >> np.uint64(32)))


@lru_cache(maxsize=1)
def shingler() -> Shingler:
    return Shingler()


@lru_cache(maxsize=1)
def _factors() -> tuple[np.ndarray, np.ndarray]:
    draw = np.random.default_rng(20).integers(1, 1 << 63, (2, SLOTS), dtype=np.uint64)
    return draw[0] * np.uint64(2) + np.uint64(1), draw[1]


def signature(hashes: np.ndarray) -> bytes:
    """SLOTS big-endian 32-bit values; prefixes of the bytes are prefixes of the order."""
    a, b = _factors()
    least = np.full(SLOTS, np.iinfo(np.uint64).max, np.uint64)
    for start in range(0, len(hashes), 1024):
        part = hashes[start:start + 1024, None] * a + b
        np.minimum(least, part.min(axis=0), out=least)
    # The values that are smallest differ in their high bits only rarely: mix before cutting.
    least ^= least >> np.uint64(31)
    least *= np.uint64(0x94D049BB133111EB)
    return (least >> np.uint64(32)).astype(">u4").tobytes()


def signatures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, key, n_shingles, set_hash, sig, low) of every row; null from set_hash on for empty sets.

    ``low`` is the last byte of each value of the signature.
    """
    ship_package(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = shingler()
        for batch in batches:
            sizes, keys, sigs, lows = [], [], [], []
            for text in batch.column(2):
                found = made.hashes(text.as_py())
                sizes.append(len(found))
                keys.append(xxhash.xxh3_128_digest(found.tobytes()) if len(found) else None)
                sigs.append(signature(found) if len(found) else None)
                lows.append(sigs[-1] and sigs[-1][3::4])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()),
                 pa.array(sigs, pa.binary()), pa.array(lows, pa.binary())],
                ["id", "key", "n_shingles", "set_hash", "sig", "low"])

    kind = docs.schema[id_col].dataType.simpleString()
    return (docs.select(F.col(id_col).alias("id"), row_key(id_col, text_col).alias("key"),
                        as_text(text_col).alias("text"))
            .mapInArrow(run, f"id {kind}, key long, n_shingles long, set_hash binary, sig binary, low binary"))


def regions(classes: DataFrame, most: int = REGION) -> tuple[DataFrame, DataFrame | None]:
    """(region, class, size, low): each class once for each tree, by regions of ``most`` members;
    and the dense ones (class), those in regions full at the first depth, None without any.

    ``low`` is read from the tree's slot on, so that rows can be sorted by it. Only members of
    full regions go on to the next depth; the others are done.
    """
    trees = classes.select("class", "size", "sig", "low", F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("tree"))
    start = F.col("tree") * (SLOTS // TREES)
    low = F.concat("low", "low").substr(start + 1, F.lit(SLOTS))
    rows = trees.select("class", "size", "tree", low.alias("low"), F.concat("sig", "sig").alias("twice"))
    order = lambda depth: F.col("twice").substr(4 * start + 1, F.lit(4 * depth))
    region = lambda depth: F.xxhash64("tree", order(depth))
    columns = ["region", "class", "size", "low"]
    done, dense = [], None
    rows = rows.withColumn("region", region(DEPTHS[0]))
    for depth, deeper in zip(DEPTHS, (*DEPTHS[1:], None)):
        full = rows.groupBy("region").agg(F.count(F.lit(1)).alias("members")).where(F.col("members") > most)
        full = materialize(full.withColumnRenamed("region", "full"), "full-regions")
        if full.isEmpty():
            return _all(done + [rows.select(*columns)]), dense
        is_full = F.col("region") == F.col("full")
        done.append(rows.join(full, is_full, "left_anti").select(*columns))
        rows = rows.join(full, is_full)
        if deeper:
            rows = materialize(rows.drop("full", "members").withColumn("region", region(deeper)), "full-members")
            if dense is None:
                dense = rows.select("class").distinct()
    # Equal in all slots: every tree parts them in another way, so that they stay connected.
    part = F.pmod(F.xxhash64("class", "tree"), F.ceil(F.col("members") / most))
    done.append(rows.withColumn("region", F.xxhash64("region", part)).select(*columns))
    return _all(done), dense


def _all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def least_agreement(slots: int = SLOTS, limit: tuple[int, int] = SIMILARITY, deviations: float = DEVIATIONS) -> int:
    """Slots that a pair at the limit agrees in, but for 1 in 75,000."""
    p = limit[0] / limit[1]
    return int(np.floor(slots * (p - deviations * (p * (1 - p) / slots) ** 0.5)))


def sketches(texts: DataFrame, most: int = SKETCH) -> DataFrame:
    """(class, sketch): the ``most`` smallest hashes of the sets of (class, text), 32 bits of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = shingler()
        for batch in batches:
            least = [(made.hashes(t.as_py())[:most] >> np.uint64(32)).astype("<u4").tobytes() for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(least, pa.binary())], ["class", "sketch"])

    return texts.select("class", "text").mapInArrow(run, "class long, sketch binary")


def may_link(sets: list[np.ndarray], sizes: np.ndarray, limit: tuple[int, int] = SIMILARITY,
             deviations: float = DEVIATIONS) -> np.ndarray:
    """Which sets can be links by their sketches, each sorted, as a matrix.

    Complete ones are compared with one hash to spare, as 32 bits may collide; of others
    the part below the lesser of their ends is a sample of the union.
    """
    n = len(sets)
    values, owner = np.concatenate(sets), np.repeat(np.arange(n), [len(x) for x in sets])
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    _, column, held = np.unique(values, return_inverse=True, return_counts=True)
    both = np.zeros((n, n), np.float32)
    few = held[column] <= 8
    c, o = column[few], owner[few]
    for k in range(1, min(8, len(c))):
        same = c[k:] == c[:-k]
        np.add.at(both, (o[k:][same], o[:-k][same]), 1)
    both += both.T
    columns = np.cumsum(held > 8) - 1
    c, o = columns[column[~few]], owner[~few]
    ends = np.searchsorted(c, np.arange(0, (c[-1] if len(c) else -1) + 2048 + 1, 2048))
    for start, (a, b) in zip(range(0, 1 << 62, 2048), zip(ends, ends[1:])):
        held_by = np.zeros((n, 2048), np.float32)
        held_by[o[a:b], c[a:b] - start] = 1
        both += held_by @ held_by.T
    whole = np.maximum(sizes[:, None], sizes[None, :]) <= SKETCH
    last = np.array([1 << 32 if size <= SKETCH else int(x[-1]) for x, size in zip(sets, sizes)], np.int64)
    below = np.stack([np.searchsorted(x, last, "right") for x in sets])
    union, share = below + below.T - both, limit[0] / limit[1]
    spare = np.where(whole, 1, 1 + deviations * np.sqrt(share * (1 - share) * union))
    return both + spare >= share * union


def _pairs_of_region(ids: np.ndarray, sizes: np.ndarray, bits: np.ndarray, labels: np.ndarray | None,
                     sets: list[np.ndarray] | None, least: int):
    """Pairs that agree enough; the last value tells if some were left for later.

    Sets whose sizes differ by more than the limit can't be as similar as it.
    """
    out, left = [], False
    linked = None if sets is None else may_link(sets, sizes)
    for i in range(1, len(ids)):
        small, large = np.minimum(sizes[:i], sizes[i]), np.maximum(sizes[:i], sizes[i])
        near = SIMILARITY[1] * small >= SIMILARITY[0] * large
        if labels is not None:
            near &= labels[:i] != labels[i]
        if linked is not None:
            near &= linked[i, :i]
        near = np.flatnonzero(near)
        if not len(near):
            continue
        agree = (bits[near] == bits[i]).sum(axis=1)
        found, agree = near[agree >= least], agree[agree >= least]
        if labels is None and len(found) > NEAREST:
            found, left = found[np.argpartition(-agree, NEAREST)[:NEAREST]], True
        out += [(ids[i], ids[j]) for j in found]
    return out, left


def held_shingles(blocks: DataFrame) -> DataFrame:
    """(block, shingle, n): each shingle of the texts of each ``block`` once, and how many of them have it."""

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        made = shingler()
        found = [made.hashes(t.as_py()) for t in rows["text"]]
        values, n = np.unique(np.concatenate(found), return_counts=True)
        return pa.table({"block": np.full(len(values), key[0].as_py(), np.int64),
                         "shingle": values.view(np.int64), "n": n})

    return blocks.groupBy("block").applyInArrow(run, "block long, shingle long, n long")


def prefixes(texts: DataFrame) -> DataFrame:
    """(class, size, shingle, n): of the shingles of each set, rarest first, those that a set as
    similar as the limit can't all miss, and the number of sets that have them, from two on.

    ``texts`` is (class, text). Texts are dealt into blocks of about ``BLOCK_BYTES``, and only the
    distinct shingles of a block move: what the texts of a dense group share moves once a block.
    """
    least = lambda size: -(-size * SIMILARITY[0] // SIMILARITY[1])

    def run(key: tuple, rows: pa.Table, counts: pa.Table) -> pa.Table:
        made = shingler()
        shared, n = counts["shingle"].to_numpy(), counts["n"].to_numpy()
        order = np.argsort(shared)
        shared, n = shared[order], n[order]
        out = []
        for c, text in zip(rows["class"].to_pylist(), rows["text"]):
            held = made.hashes(text.as_py()).view(np.int64)
            size = len(held)
            at = np.searchsorted(shared, held)
            at = at[shared.take(at, mode="clip") == held] if len(shared) else at[:0]
            # Those of one set come first in it and lead to nothing.
            length = size - least(size) + 1 - (size - len(at))
            first = at[np.lexsort((shared[at], n[at]))][:max(length, 0)]
            out.append((np.full(len(first), c), np.full(len(first), size), shared[first], n[first]))
        columns = [np.concatenate(x).astype(np.int64) for x in zip(*out)] or [np.zeros(0, np.int64)] * 4
        return pa.table(dict(zip(["class", "size", "shingle", "n"], columns)))

    total = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = texts.select(F.pmod("class", F.lit(total // BLOCK_BYTES + 1)).alias("block"), "class", "text")
    held = materialize(held_shingles(blocks), "near-held")
    shared = held.groupBy("shingle").agg(F.sum("n").alias("n")).where("n > 1")
    counts = held.select("block", "shingle").join(shared, "shingle").select("block", "shingle", "n")
    return (blocks.groupBy("block").cogroup(counts.groupBy("block"))
            .applyInArrow(run, "class long, size long, shingle long, n long"))


def rare_regions(prefix: DataFrame, classes: DataFrame, few: int = FEW) -> DataFrame:
    """(region, class, size, low): the classes of each shingle of ``prefix`` that at most ``few`` have.

    Shingles of one passage lead to the same classes, which are one region then.
    """
    held = prefix.where(F.col("n") <= few).groupBy("shingle").agg(F.sort_array(F.collect_list("class")).alias("held"))
    lists = held.where(F.size("held") > 1).select("held").distinct()
    rows = lists.select(F.xxhash64(F.lit("rare"), "held").alias("region"), F.explode("held").alias("class"))
    return rows.join(classes.select("class", "size", "low"), "class").select("region", "class", "size", "low")


def across(prefix: DataFrame, classes: DataFrame, joined: DataFrame, few: int = FEW, most: int = REGION) -> DataFrame:
    """(region, class, size, low, label): blocks of the classes of each shingle of ``prefix`` that more
    than ``few`` have, so that any two of different components, ``joined``, are in one.

    The largest component of a shingle meets the others only, not itself.
    """
    labels = joined.select(F.col("node").alias("l_class"), "label")
    rows = prefix.where(F.col("n") > few).select("shingle", "class", "size").join(
        labels, F.col("class") == F.col("l_class"), "left")
    rows = materialize(rows.select("shingle", "class", "size", F.coalesce("label", "class").alias("label")), "near-common")
    counts = rows.groupBy("shingle", "label").agg(F.count(F.lit(1)).alias("n"))
    mixed = counts.groupBy("shingle").agg(F.max(F.struct("n", "label")).alias("major"), F.sum("n").alias("n"))
    mixed = mixed.where("n > major.n").select("shingle", "major", (F.col("n") - F.col("major.n")).alias("others"))
    is_major = F.col("label") == F.col("major.label")
    of_major, of_others = F.ceil(F.col("major.n") / most).cast("int"), F.ceil(F.col("others") / most).cast("int")
    part = F.pmod(F.xxhash64("class"), F.when(is_major, of_major).otherwise(of_others)).cast("int")
    rows = rows.join(mixed, "shingle").withColumn("part", part)
    numbers = lambda n: F.sequence(F.lit(0), n - 1)
    block = lambda kind, x, y: F.xxhash64(F.lit(kind), "shingle", x, y)
    here = F.col("part")
    among = F.transform(numbers(of_others), lambda x: block("others", F.least(here, x), F.greatest(here, x)))
    to_major = F.transform(numbers(of_major), lambda x: block("major", here, x))
    from_major = F.transform(numbers(of_others), lambda x: block("major", x, here))
    rows = rows.select("class", "size", "label", F.explode(
        F.when(is_major, from_major).otherwise(F.concat(among, to_major))).alias("region"))
    return rows.join(classes.select("class", "low"), "class").select("region", "class", "size", "low", "label")


def candidates(members: DataFrame) -> DataFrame:
    """(a, b) with a > b; rows with b null name, in ``region``, a region that is to be seen again.

    With a ``label`` only pairs of different ones, with a ``sketch`` only what can be a link by it.
    """
    least = least_agreement()
    further = [c for c in ("label", "sketch") if c in members.columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        region = None

        def flush():
            if len(held) < 2:
                return None
            ids = np.array([h[0] for h in held], np.int64)
            sizes = np.array([h[1] for h in held], np.int64)
            bits = np.frombuffer(b"".join([h[2] for h in held]), np.uint8).reshape(len(held), -1)
            labels = np.array([h[3] for h in held], np.int64) if further else None
            sets = [np.frombuffer(h[4], "<u4") for h in held] if "sketch" in further else None
            pairs, left = _pairs_of_region(ids, sizes, bits, labels, sets, least)
            rows = [(max(a, b), min(a, b), region) for a, b in pairs] + [(0, None, region)] * left
            return rows and pa.RecordBatch.from_arrays(
                [pa.array([r[k] for r in rows], pa.int64()) for k in range(3)], ["a", "b", "region"])

        for batch in batches:
            columns = [batch.column(k).to_pylist() for k in range(4 + len(further))]
            for r, *row in zip(*columns):
                if r != region:
                    if found := flush():
                        yield found
                    held, region = [], r
                held.append(row)
        if found := flush():
            yield found

    members = members.select("region", "class", "size", "low", *further)
    return (members.repartition("region").sortWithinPartitions("region", "low")
            .mapInArrow(run, "a long, b long, region long"))


def confirmed(pairs: DataFrame, texts: DataFrame, limit: tuple[int, int] = SIMILARITY) -> DataFrame:
    """(u, v) of the pairs whose full sets are similar enough; ``texts`` is (class, text)."""
    a = texts.withColumnsRenamed({"class": "a", "text": "text_a"})
    b = texts.withColumnsRenamed({"class": "b", "text": "text_b"})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, last, q = shingler(), None, None
        sets: dict[int, np.ndarray] = {}
        kept = 0
        for batch in batches:
            us, vs = [], []
            for u, v, x, y in zip(*batch.columns):
                # Rows of one b come together.
                if v != last:
                    last, q = v, made.hashes(y.as_py())
                # The classes of a dense group are in many pairs.
                if (p := sets.get(key := u.as_py())) is None:
                    if kept > KEPT_HASHES:
                        sets, kept = {}, 0
                    p = sets[key] = made.hashes(x.as_py())
                    kept += len(p)
                both = len(np.intersect1d(p, q, assume_unique=True))
                if limit[1] * both >= limit[0] * (len(p) + len(q) - both):
                    us.append(key)
                    vs.append(v.as_py())
            yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], ["u", "v"])

    return (pairs.join(a, "a").join(b, "b").select("a", "b", "text_a", "text_b")
            .mapInArrow(run, "u long, v long"))


def duplicate_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                     region: int = REGION) -> DataFrame:
    """(id, key, n_shingles, component_id, component_key) of every row.

    ``key`` names a row by id and text (``row_key``); ``component_key`` is that of the first row
    of its group, and null for rows without words or id.
    """
    docs = docs.select(F.col(id_col).alias("doc_id"), as_text(text_col).alias("text"))
    keyed = docs.select(row_key("doc_id", "text").alias("key"), "text")
    signed = materialize(signatures(docs), "near-signatures")
    of_set = F.xxhash64("set_hash")
    owned = signed.where("id is not null and set_hash is not null").select(of_set.alias("class"), "id", "key", "sig",
                                                                             "low", F.col("n_shingles").alias("size"))
    classes = materialize(owned.groupBy("class").agg(
        F.min(F.struct("id", "key")).alias("first"),
        F.first("sig").alias("sig"), F.first("low").alias("low"), F.first("size").alias("size")), "near-classes")
    members, dense = regions(classes, region)
    # One text stands for a class: that of its first document.
    firsts = classes.select("class", "first", F.col("first.key").alias("key"))

    def texts_of(wanted: DataFrame) -> DataFrame:
        # Texts of other classes don't move, however many are wanted.
        ids = materialize(firsts.select("class", "key").join(wanted, "class", "left_semi"), "near-wanted")
        few = marked(keyed, ids).where("marked").select(F.col("key").alias("text_key"), "text")
        return (few.join(ids, F.col("text_key") == F.col("key")).select("class", "text")
                .dropDuplicates(["class"]))

    def texts(p: DataFrame) -> DataFrame:
        return texts_of(p.select(F.col("a").alias("class")).unionByName(p.select(F.col("b").alias("class"))))

    if dense is not None:
        held = materialize(texts_of(dense), "near-dense-texts")
        prefix = materialize(prefixes(held), "near-prefixes")
        members = members.unionByName(materialize(rare_regions(prefix, classes), "near-rare"))
    found = materialize(candidates(members), "near-candidates")
    pairs = found.where("b is not null").select("a", "b").distinct()
    links = materialize(confirmed(pairs, texts(pairs)), "near-links")
    joined = components(links)

    def further(labelled: DataFrame, links: DataFrame, joined: DataFrame) -> tuple[DataFrame, DataFrame]:
        """The links and components with those of pairs of different labels."""
        more = candidates(labelled).select("a", "b").distinct().join(pairs, ["a", "b"], "left_anti")
        more = materialize(more, "near-candidates")
        if more.isEmpty():
            return links, joined
        new = materialize(confirmed(more, texts(more)), "near-links")
        if new.isEmpty():
            return links, joined
        links = links.unionByName(new)
        return links, components(links)

    again = found.where("b is null").select("region").distinct()
    if not again.isEmpty():
        labels = joined.select(F.col("node").alias("l_class"), "label")
        seen = marked(members.withColumnRenamed("region", "key"), again.withColumnRenamed("region", "key"))
        seen = seen.where("marked").drop("marked").withColumnRenamed("key", "region")
        rest = materialize(seen.join(again, "region", "left_semi")
                           .join(labels, F.col("class") == F.col("l_class"), "left")
                           .select("region", "class", "size", "low", F.coalesce("label", "class").alias("label")),
                           "near-again")
        split = (rest.groupBy("region").agg(F.min("label").alias("x"), F.max("label").alias("y"))
                 .where("x <> y").select("region"))
        rest = rest.join(split, "region", "left_semi")
        rest = rest.join(materialize(sketches(texts_of(rest.select("class"))), "near-sketches"), "class")
        links, joined = further(rest, links, joined)
    if dense is not None:
        rest = materialize(across(prefix, classes, joined, most=region), "near-across")
        least = materialize(sketches(held.join(rest.select("class"), "class", "left_semi")), "near-sketches")
        rest = rest.join(least, "class")
        links, joined = further(rest, links, joined)
    groups = joined.join(firsts, F.col("node") == F.col("class"))
    least = groups.groupBy("label").agg(F.min("first").alias("least"))
    named = materialize(groups.select("class", "label").join(least, "label").select("class", "least"), "near-components")
    own = firsts.join(named, "class", "left").select(
        F.col("class").alias("o_class"), F.coalesce("least", "first").alias("component"))
    rows = signed.select("id", "key", "n_shingles", of_set.alias("class"),
                         F.expr("set_hash is not null and id is not null").alias("has"))
    rows = rows.join(own, (F.col("class") == F.col("o_class")) & F.col("has"), "left")
    return rows.select("id", "key", "n_shingles", F.coalesce("component.id", "id").alias("component_id"),
                       F.col("component.key").alias("component_key"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    region: int = REGION) -> DataFrame:
    """(id, n_shingles, component_id, kept) of every row."""
    rows = duplicate_groups(docs, id_col, text_col, region)
    return rows.select(F.col("id").alias(id_col), "n_shingles", "component_id",
                       F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))


def first_of_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    region: int = REGION) -> DataFrame:
    """The rows of ``docs``, one of each group: its first by id, and one of equal rows.

    Rows without words or id stay. Of rows with equal id and text, the smallest by all
    columns stays.
    """
    rows = materialize(duplicate_groups(docs, id_col, text_col, region).where("component_key is not null")
                       .groupBy("key", "component_key").agg(F.count(F.lit(1)).alias("rows")), "near-rows")
    # Of all others, which are most, no row moves.
    touched = rows.where("key <> component_key or rows > 1").select("key", F.expr("key = component_key").alias("repeated"))
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), row_key(id_col, text_col).alias("key"))
    found = marked(keyed, touched)
    whole = found.where("not marked").select("row")
    named = touched.withColumnRenamed("key", "n_key")
    some = found.where("marked").join(named.hint("merge"), F.col("key") == F.col("n_key"), "left")
    once = some.where("n_key is null").select("row")
    least = some.where("repeated").groupBy("key").agg(F.min("row").alias("row")).select("row")
    return reduce(DataFrame.unionByName, [whole, once, least]).select("row.*")
