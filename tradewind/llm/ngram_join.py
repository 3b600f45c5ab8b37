"""Near copies by n-gram Jaccard: size-banded tiles, bitmap bounds, exact intersection of sorted arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import written
from .components import components
from .hashing import Texts, mix64, windows
from .text import slices

_U = np.uint64

#: A pair at similarity s shares no tile with probability (1 - s^ROWS)^TILES: under 3e-15 at 0.8.
ROWS, TILES = 4, 64
#: 64-bit words of the parity bitmap.
BITMAP_WORDS = 8
#: Turns of checks against drawn members before all that is left is checked, and partners of a class in each.
#: A turn costs some twenty shuffles of small tables; one with eight partners joins nearly all families.
STAR_TURNS, STAR_PARTNERS = 1, 8
#: Bits (as a power of two) of the fixed-size sieve that spares texts of unlinked documents a second look.
SIEVE_BITS = 22

_MULTIPLIERS = (mix64(np.arange(1, ROWS * TILES + 1, dtype=_U) * _U(0x9E3779B97F4A7C15)) | _U(1)).reshape(1, -1)


def shingle_sets(texts: list[str | None], width: int = 5) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; with fewer words, the whole sequence is one shingle."""
    t = Texts(texts, fold=True)
    word = t.words()
    first, h = windows(word, t.word_doc, width)
    count = t.words_per_text()
    start = np.concatenate(([0], np.cumsum(np.maximum(count - width + 1, 0))))
    at = np.concatenate(([0], np.cumsum(count)))
    out = []
    for i in range(t.count):
        if count[i] >= width:
            out.append(np.unique(h[start[i] : start[i + 1]]))
        elif count[i]:
            z = np.array([count[i]], dtype=_U)
            for w in range(at[i], at[i + 1]):
                z = mix64(z * _U(31) + word[w : w + 1])
            out.append(z)
        else:
            out.append(np.empty(0, dtype=_U))
    return out


def set_digest(s: np.ndarray) -> int:
    """A 64-bit digest of a sorted set."""
    z = mix64(s * _U(0xD6E8FEB86659FD93) + _U(len(s)))
    return int(mix64(np.add.reduce(z, keepdims=True) ^ _U(len(s)))[0])


def tile_keys(s: np.ndarray) -> np.ndarray:
    """Keys of the tiles a set lies in: its size band, and the next band when a partner may be there.

    Bands double in size; a set within 0.8 of the next band's least size lies in that band too, so
    sets of one pair share a band. Within a band, each tile is addressed by ``ROWS`` minima.
    """
    n = len(s)
    least = np.full(ROWS * TILES, np.iinfo(np.uint64).max, dtype=_U)
    for i in range(0, n, 256):
        np.minimum(least, (s[i : i + 256, None] * _MULTIPLIERS).min(axis=0), out=least)
    h = np.zeros(TILES, dtype=_U)
    for j in range(ROWS):
        h = mix64(h * _U(31) + least[j * TILES : (j + 1) * TILES])
    h = h + np.arange(TILES, dtype=_U) * _U(0xA24BAED4963EE407)
    band = n.bit_length() - 1
    bands = [band] + [band + 1] * (10 * n >= 8 << (band + 1))
    return np.concatenate([mix64(h + _U(b * 0x9FB21C651E98DF25 & 2**64 - 1)) for b in bands])


def bitmap(s: np.ndarray) -> np.ndarray:
    """Parity of the elements on each of 64 x ``BITMAP_WORDS`` positions: one differing element flips one bit."""
    bits = np.bincount((mix64(s ^ _U(0x5851F42D4C957F2D)) % _U(64 * BITMAP_WORDS)).astype(np.int64), minlength=64 * BITMAP_WORDS) & 1
    return np.packbits(bits.astype(np.uint8)).view(np.int64)


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _prepare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: set[int] = set()
    longs = pa.list_(pa.int64())
    for batch in slices(batches, max_bytes=1 << 20):
        n, cls, keys, maps = [], [], [], []
        for s in shingle_sets(batch.column("text").to_pylist()):
            n.append(len(s))
            digest = set_digest(s) if len(s) else None
            cls.append(None if digest is None else digest - (1 << 64) * (digest >> 63))
            # Copies inside a task need no second set of keys; tiles hold classes, not documents.
            fresh = digest is not None and digest not in seen
            keys.append(_signed(tile_keys(s)) if fresh else None)
            maps.append(bitmap(s) if fresh else None)
            if fresh:
                seen.add(digest)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(cls, pa.int64()), pa.array(keys, longs), pa.array(maps, longs)], names=["doc_id", "n", "cls", "keys", "bits"])


def _tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (key, cls) to the distinct classes of every tile with two or more.

    Equal member lists are told once per task; the last, unfinished tile is carried to the next batch.
    """
    told: set[bytes] = set()
    keys = classes = np.empty(0, dtype=np.int64)

    def pack(found: list[np.ndarray]) -> pa.RecordBatch:
        new = {m: f for f in found if (m := f.tobytes()) not in told}
        if len(told) > 100_000:
            told.clear()
        told.update(new)
        return pa.RecordBatch.from_arrays([pa.array(list(new.values()), pa.list_(pa.int64()))], names=["members"])

    for batch in batches:
        keys = np.concatenate((keys, batch.column("key").to_numpy()))
        classes = np.concatenate((classes, batch.column("cls").to_numpy()))
        fresh = np.ones(len(keys), dtype=bool)
        fresh[1:] = (keys[1:] != keys[:-1]) | (classes[1:] != classes[:-1])
        keys, classes = keys[fresh], classes[fresh]
        edges = np.concatenate(([0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]))
        done = np.flatnonzero(np.diff(edges)[:-1] > 1)
        yield pack([classes[edges[i] : edges[i + 1]] for i in done])
        keys, classes = keys[edges[-2] :], classes[edges[-2] :]
    if len(keys) > 1:
        yield pack([classes])


def _slot(ids: np.ndarray) -> np.ndarray:
    return (mix64(ids.astype(np.int64).view(_U)) >> _U(64 - SIEVE_BITS)).astype(np.int64)


def _sieve(ids: DataFrame) -> np.ndarray:
    """A bit for the hash of every id: at most 2^SIEVE_BITS of them, however many ids there are."""

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flags = np.zeros(1 << SIEVE_BITS, dtype=np.uint8)
        for batch in batches:
            flags[_slot(batch.column("doc_id").to_numpy())] = 1
        words = np.packbits(flags, bitorder="little").view(np.int64)
        at = np.flatnonzero(words)
        for i in range(0, len(at), 10_000):
            yield pa.RecordBatch.from_arrays([pa.array(at[i : i + 10_000]), pa.array(words[at[i : i + 10_000]])], names=["at", "word"])

    words = np.zeros((1 << SIEVE_BITS) // 64, dtype=np.int64)
    for r in ids.mapInArrow(bits, "at long, word long").groupBy("at").agg(F.bit_or("word").alias("word")).collect():
        words[r["at"]] = r["word"]
    return np.unpackbits(words.view(np.uint8), bitorder="little").astype(bool)


def _bounded(a: Column, b: Column, words: int = BITMAP_WORDS) -> Column:
    """Whether the bitmaps leave room for similarity 0.8: 9 x symmetric difference <= sum of sizes."""
    differ = sum((F.bit_count(a["bits"][i].bitwiseXOR(b["bits"][i])) for i in range(words)), F.lit(0))
    return (9 * differ <= a["n"] + b["n"]) & (5 * F.least(a["n"], b["n"]) >= 4 * F.greatest(a["n"], b["n"]))


def _verified(pairs: DataFrame, arrays: DataFrame) -> DataFrame:
    """The pairs (a, b) of classes whose sorted arrays meet in 80 % of their union."""

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x"), batch.column("y")):
                x, y = np.frombuffer(x.as_buffer(), dtype=_U), np.frombuffer(y.as_buffer(), dtype=_U)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= 80 * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    left = arrays.select(F.col("cls").alias("a"), F.col("shingles").alias("x"))
    right = arrays.select(F.col("cls").alias("b"), F.col("shingles").alias("y"))
    return written(pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(meet, "a long, b long"), "ngram-links")


def _open_tiles(members: DataFrame, known: DataFrame, turn: int) -> DataFrame:
    """Members (tile, cls, comp) of the tiles that hold several components, with the tile's largest
    component and a member of it, drawn anew by a hash at each turn."""
    placed = members.join(known, F.col("cls") == F.col("node"), "left").select("tile", "cls", F.coalesce("label", "cls").alias("comp"))
    draw = F.struct(F.xxhash64(F.lit(turn), "tile", "cls").alias("h"), F.col("cls").alias("center"))
    sizes = placed.groupBy("tile", "comp").agg(F.count("*").alias("k"), F.min(draw).alias("d"))
    top = sizes.groupBy("tile").agg(F.max(F.struct("k", "d", "comp")).alias("top"), F.count("*").alias("comps")).where("comps > 1")
    return placed.join(top.select("tile", F.col("top.comp").alias("largest"), F.col("top.d.center").alias("center")), "tile")


def near_copies(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``documents``: doc_id, n_shingles, class_id, component_id.

    Shingles are 5 words of the text with A-Z lower-cased. Documents of one set form a class; classes
    link when 100 x intersection >= 80 x union, checked exactly on sorted arrays; ``component_id`` is
    the least doc_id reachable. Tiles (size band and minima) only propose: no pair is proposed by less
    than a shared tile, and a linked pair shares one except with probability 3e-15. First,
    members outside a tile's largest component are checked against members of it drawn by hash; then
    only pairs of different components that the sizes and bitmaps leave possible are checked, every one
    of them, once: in the first tile both lie in. So a group of near copies costs about its size, not its square, and no tile is capped.

    Null texts and texts without words have no shingles, class null and their own id as component.
    Null ids are never the least; a component of null ids only has component null. Repeated rows stay;
    an empty table gives an empty result; extra columns are not read.
    """
    spark = documents.sparkSession
    rows = documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    prepared = written(rows.mapInArrow(_prepare, "doc_id long, n long, cls long, keys array<long>, bits array<long>"), "ngram-sets")
    tiled = prepared.where("keys is not null").select(F.explode("keys").alias("key"), "cls")
    lists = written(tiled.repartition("key").sortWithinPartitions("key", "cls").mapInArrow(_tiles, "members array<long>").distinct(), "ngram-tiles")

    members = lists.select(F.xxhash64("members").alias("tile"), F.explode("members").alias("cls"))
    classes = prepared.where("cls is not null").groupBy("cls").agg(F.min("doc_id").alias("least"), F.max("n").alias("n"), F.max("bits").alias("bits"))
    involved = written(members.select("cls").distinct().join(classes, "cls"), "ngram-classes")

    sieve = spark.sparkContext.broadcast(_sieve(involved.where("least is not null").select(F.col("least").alias("doc_id"))))

    def arrays_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id")
            keep = np.ones(len(batch), dtype=bool)
            there = ids.is_valid().to_numpy(zero_copy_only=False)
            keep[there] = sieve.value[_slot(ids.drop_null().to_numpy())]
            for part in slices(iter([batch.filter(pa.array(keep))]), max_bytes=1 << 20):
                sets = [s for s in shingle_sets(part.column("text").to_pylist()) if len(s)]
                digests = np.array([set_digest(s) for s in sets], dtype=_U)
                yield pa.RecordBatch.from_arrays([pa.array(_signed(digests)), pa.array([s.tobytes() for s in sets], pa.binary())], names=["cls", "shingles"])

    looked = rows.mapInArrow(arrays_of, "cls long, shingles binary")
    arrays = written(looked.join(involved.select("cls"), "cls", "left_semi").dropDuplicates(["cls"]), "ngram-arrays")

    info = lambda cls, value: involved.select(F.col("cls").alias(cls), F.struct("n", "bits").alias(value))

    def candidates(pairs: DataFrame) -> DataFrame:
        ordered = pairs.select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b")).distinct()
        return ordered.join(info("a", "u"), "a").join(info("b", "v"), "b").where(_bounded(F.col("u"), F.col("v"))).select("a", "b")

    links = spark.createDataFrame([], "a long, b long")
    known = spark.createDataFrame([], "node long, label long")
    for turn in range(STAR_TURNS):
        opened = _open_tiles(members, known, turn)
        stars = opened.where("comp <> largest").groupBy(F.col("cls").alias("p")).agg(F.sort_array(F.collect_set(F.struct(F.xxhash64(F.lit(turn), "center").alias("h"), "center"))).alias("c"))
        links = links.unionByName(_verified(candidates(stars.select("p", F.explode(F.slice(F.col("c.center"), 1, STAR_PARTNERS)).alias("q"))), arrays))
        known = components(links)

    # What is left: tiles that still hold several components. In each, the members outside its largest
    # component meet the members of other components, in the first tile a pair has in common only.
    # Tiles of two components are all open, so the tiles listed here hold every common one.
    placed = written(_open_tiles(members, known, STAR_TURNS), "ngram-open")
    lying = placed.groupBy("cls").agg(F.sort_array(F.collect_set("tile")).alias("tiles")).join(involved.select("cls", "n", "bits"), "cls")
    met = written(placed.join(lying.select("cls", F.struct("n", "bits", "tiles").alias("v")), "cls"), "ngram-met")
    outside = F.col("comp") != F.col("largest")
    left = met.where(outside).select("tile", F.col("cls").alias("p"), F.col("comp").alias("c"), F.col("v").alias("u"))
    crossed = left.join(met.select("tile", F.col("cls").alias("q"), F.col("comp").alias("d"), outside.alias("out"), "v"), "tile")
    once = (F.col("c") != F.col("d")) & (~F.col("out") | (F.col("p") < F.col("q")))
    first = F.array_min(F.array_intersect("u.tiles", "v.tiles")) == F.col("tile")
    crossed = crossed.where(once & _bounded(F.col("u"), F.col("v")) & first).select(F.col("p").alias("a"), F.col("q").alias("b"))

    found = components(links.unionByName(_verified(crossed, arrays)))
    least = involved.join(found, F.col("cls") == F.col("node"), "left").select("cls", "least", F.coalesce("label", "cls").alias("comp"))
    per_component = least.groupBy("comp").agg(F.min("least").alias("component"))
    linked = least.join(per_component, "comp").select("cls", "component")
    own = prepared.where("cls is not null").groupBy("cls").agg(F.min("doc_id").alias("least"))
    by_class = own.join(linked, "cls", "left").select(F.col("cls").alias("class_id"), F.coalesce("component", "least").alias("component_id"))
    out = prepared.select("doc_id", F.col("n").alias("n_shingles"), F.col("cls").alias("class_id")).join(by_class, "class_id", "left")
    return out.select("doc_id", "n_shingles", "class_id", F.when(F.col("class_id").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))
