"""How far the word use of each source is from the others of its language: transducer recounts, exact divergences."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.ranking import dense_index
from ..session import written
from . import transducer
from .text import slices

# A term is a run of letters A-Z, a-z or any code point from 128 on (in UTF-8: any byte from 128 on).
TERM = re.compile(rb"[a-z\x80-\xff]+")

#: Terms of one transducer, bytes of transducers sent to all tasks at once, terms and sources of one block of sums.
SHARD_TERMS, WAVE_BYTES, BLOCK_TERMS, TILE_SOURCES = 100_000, 48 << 20, 4096, 512
#: Entries a task collects before it hands them on.
HELD = 1 << 22


def _rows(documents: DataFrame, lang: str, source: str, text: str) -> DataFrame:
    filled = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return documents.select(filled(lang).alias("lang"), filled(source).alias("source"), F.col(text).cast("binary").alias("text"))


def _kept(rows: DataFrame, min_documents: int) -> DataFrame:
    """(lang, term, ord): terms in enough documents of the language, numbered in byte order."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, Counter] = {}
        flush = lambda: [
            pa.RecordBatch.from_arrays([pa.array([k] * len(c), pa.string()), pa.array([t.decode() for t in c]), pa.array(c.values(), pa.int64())], names=["lang", "term", "n"]) for k, c in seen.items() if c
        ]
        for batch in slices(batches):
            for k, t in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
                seen.setdefault(k, Counter()).update(set(TERM.findall((t or b"").lower())))
            if sum(map(len, seen.values())) > HELD // 8:
                yield from flush()
                seen.clear()
        yield from flush()

    counted = rows.select("lang", "text").mapInArrow(count, "lang string, term string, n long").groupBy("lang", "term").agg(F.sum("n").alias("n"))
    kept = written(counted.where(F.col("n") >= min_documents).select("lang", "term"), "kept-terms")
    return written(dense_index(kept, "term", "term", "ord", by=["lang"]), "term-ordinals")


def _transducers(kept: DataFrame, shard_terms: int) -> DataFrame:
    """(lang, shard, base, size, stored): a transducer for each run of ordinals, built where its terms are."""

    def make(key: tuple, terms: pd.DataFrame) -> pd.DataFrame:
        ordered = terms.sort_values("ord")
        stored = transducer.build([t.encode() for t in ordered["term"]])
        return pd.DataFrame({"lang": [key[0]], "shard": [key[1]], "base": [int(ordered["ord"].iloc[0])], "size": [len(stored)], "stored": [stored]})

    shards = kept.withColumn("shard", F.expr(f"ord div {shard_terms}"))
    return written(shards.groupBy("lang", "shard").applyInPandas(make, "lang string, shard long, base long, size long, stored binary"), "transducers")


def _recount(rows: DataFrame, machines: DataFrame, wave_bytes: int) -> DataFrame:
    """(lang, source, ord, n): every text streamed through the transducers of its language.

    At most ``wave_bytes`` of them (or one) go to the tasks at once; a larger vocabulary takes more passes.
    """
    spark, waves, room = rows.sparkSession, [], 0
    for r in machines.select("lang", "shard", "size").orderBy("lang", "shard").toLocalIterator():
        if not waves or r["size"] > room:
            waves.append([])
            room = wave_bytes
        room -= r["size"]
        waves[-1].append((r["lang"], r["shard"]))

    def passed(wave: list[tuple[str, int]]) -> DataFrame:
        first, last = wave[0], wave[-1]
        place = F.struct("lang", "shard")
        edge = lambda at: F.struct(F.lit(at[0]).alias("lang"), F.lit(at[1]).cast("long").alias("shard"))
        sent = spark.sparkContext.broadcast([(r["lang"], r["base"], bytes(r["stored"])) for r in machines.where((place >= edge(first)) & (place <= edge(last))).collect()])

        def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ready: dict[str, list] = {}
            for name, base, stored in sent.value:
                ready.setdefault(name, []).append((base, transducer.Transducer(stored)))
            letter = np.zeros(256, dtype=bool)
            letter[97:123] = letter[128:] = True
            sums: dict[tuple[str, str, int], np.ndarray] = {}

            def flush() -> Iterator[pa.RecordBatch]:
                for (name, source, base), n in sums.items():
                    there = np.flatnonzero(n)
                    if len(there):
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([name] * len(there), pa.string()), pa.array([source] * len(there), pa.string()), pa.array(there + base), pa.array(n[there])], names=["lang", "source", "ord", "n"]
                        )
                sums.clear()

            for batch in slices(batches):
                by_lang: dict[str, list] = {}
                for name, source, text in zip(*(batch.column(c).to_pylist() for c in ("lang", "source", "text"))):
                    if text and name in ready:
                        by_lang.setdefault(name, []).append((source, text))
                for name, texts in by_lang.items():
                    # One run of bytes; the line feed after each text ends its last term.
                    code = np.frombuffer(b"\n".join(t for _, t in texts).lower() + b"\n", dtype=np.uint8)
                    edge = np.diff(letter[code].view(np.int8), prepend=np.int8(0))
                    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
                    text_of = np.searchsorted(np.cumsum([len(t) + 1 for _, t in texts]), start, side="right")
                    sources = sorted({s for s, _ in texts})
                    source_of = np.searchsorted(np.array(sources, dtype=object), np.array([s for s, _ in texts], dtype=object))[text_of]
                    for base, machine in ready[name]:
                        found = machine.walk(code, start, end)
                        hit = found >= 0
                        order = np.argsort(source_of[hit], kind="stable")
                        ordinal, of = found[hit][order], source_of[hit][order]
                        cuts = np.searchsorted(of, np.arange(len(sources) + 1))
                        for k, source in enumerate(sources):
                            if cuts[k] < cuts[k + 1]:
                                slot = (name, source, base)
                                if slot not in sums:
                                    if sum(map(len, sums.values())) > HELD:
                                        yield from flush()
                                    sums[slot] = np.zeros(machine.terms, dtype=np.int64)
                                n = np.bincount(ordinal[cuts[k] : cuts[k + 1]])
                                sums[slot][: len(n)] += n
            yield from flush()

        return rows.mapInArrow(stream, "lang string, source string, ord long, n long")

    parts = [passed(w) for w in waves]
    if not parts:
        return spark.createDataFrame([], "lang string, source string, ord long, n long")
    for more in parts[1:]:
        parts[0] = parts[0].unionAll(more)
    return written(parts[0].groupBy("lang", "source", "ord").agg(F.sum("n").alias("n")), "recounts")


def _share(n: np.ndarray, total: np.ndarray | int) -> np.ndarray:
    """1 + floor(10^9 * n / total), in two steps so that 64 bits hold every product up to counts of 9 * 10^13."""
    first, rest = np.divmod(n * 100_000, total)
    return 1 + first * 10_000 + rest * 10_000 // total


def _distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // (p + q)


def _compare(key: tuple, counts: pd.DataFrame, groups: pd.DataFrame) -> pd.DataFrame:
    """Sums over one block of ordinals for the pairs of two tiles of sources, and the block's terms that may rank."""
    (lang, block, left, right), top, v = key, int(groups["top"].iloc[0]), int(groups["terms"].iloc[0])
    base = int(block) * BLOCK_TERMS
    width = max(0, min(BLOCK_TERMS, v - base))
    tile = {side: groups[groups["tile"] == side].drop_duplicates("source").sort_values("source") for side in {left, right}}
    out: list[tuple] = []

    def counted(side: int) -> np.ndarray:
        own = tile[side]
        dense = np.zeros((len(own), width), dtype=np.int64)
        mine = counts[(counts["tile"] == side) & ~counts["whole"]]
        dense[np.searchsorted(own["source"].to_numpy(dtype=object), mine["source"].to_numpy(dtype=object)), mine["ord"].to_numpy() - base] = mine["n"]
        return dense

    def shares(side: int, n: np.ndarray) -> np.ndarray:
        return _share(n + 2, np.maximum(1, tile[side]["total"].to_numpy(dtype=np.int64) + 2 * v)[:, None])

    n = counted(left)
    p = shares(left, n)
    q = p if left == right else shares(right, counted(right))
    names, others = tile[left]["source"].tolist(), tile[right]["source"].tolist()
    for i, name in enumerate(names):
        for other, value in zip(others, _distance(p[i], q).sum(axis=1).tolist()):
            if name != other:
                out.append((lang, name, other, None, value))
    if right == 0 and width:
        whole = counts[counts["whole"]]
        lang_n = np.zeros(width, dtype=np.int64)
        lang_n[whole["ord"].to_numpy() - base] = whole["n"]
        lang_p = _share(lang_n + 2, int(groups["lang_total"].iloc[0]) + 2 * v)
        for i, name in enumerate(names):
            may = np.flatnonzero((n[i] > 0) & (p[i] > lang_p))
            value = _distance(p[i][may], lang_p[may])
            first = np.lexsort((may, -value))[:top]
            out += [(lang, name, None, base + int(may[k]), int(value[k])) for k in first]
    return pd.DataFrame(out, columns=["lang", "source", "other", "ord", "value"]).astype({"ord": "Int64", "value": "int64"})


def audit(documents: DataFrame, min_documents: int = 10, top: int = 10, lang: str = "lang", source: str = "source", text: str = "text", shard_terms: int = SHARD_TERMS, wave_bytes: int = WAVE_BYTES, tile_sources: int = TILE_SOURCES) -> DataFrame:
    """lang, source, part, item, value, rank: the other sources by divergence, and the terms a source overuses.

    A language keeps the terms in at least ``min_documents`` of its documents. They are numbered in byte
    order and become minimal transducers; every text is streamed through them for the counts of each
    (lang, source). Part ``pair`` ranks all other sources of the language by the summed divergence over the
    kept terms, part ``term`` the ``top`` kept terms used more often than in the whole language. Integers
    throughout; ties go to the lower ordinal, that is byte order.

    Sums run over blocks of ordinals and tiles of sources, so neither a language with most of the texts nor
    one with very many sources meets in one task. Transducers go to the tasks ``wave_bytes`` at a time.
    Null text, lang and source count as empty text; a group without terms, or a language without kept terms,
    still gets its pairs (value 0 if there are no kept terms). Very long texts pass whole, repeated rows
    count again, an empty table gives an empty result, extra columns are not read.
    """
    rows = _rows(documents, lang, source, text)
    kept = _kept(rows, min_documents)
    counts = _recount(rows, _transducers(kept, shard_terms), wave_bytes)
    totals = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = rows.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").fillna(0, "total")
    per_lang = groups.groupBy("lang").agg(F.sum("total").alias("lang_total"), F.count(F.lit(1)).alias("_sources"))
    per_lang = per_lang.join(kept.groupBy("lang").agg(F.count(F.lit(1)).alias("terms")), "lang", "left").fillna(0, "terms")
    per_lang = written(per_lang.withColumn("_tiles", F.ceil(F.col("_sources") / tile_sources)), "audit-languages")
    groups = written(groups.join(per_lang, "lang").withColumn("tile", F.expr("pmod(xxhash64(source), _tiles)")), "audit-groups")

    # A row of tile t takes part as left tile against every right one and the other way round.
    sides = F.expr("array_distinct(flatten(transform(sequence(0L, _tiles - 1), u -> array(struct(tile as left, u as right), struct(u as left, tile as right)))))")
    blocks = F.expr(f"explode(sequence(0L, greatest(0L, (terms - 1) div {BLOCK_TERMS})))")
    infos = groups.withColumn("block", blocks).withColumn("_s", F.explode(sides)).select("lang", "block", "_s.*", "source", "tile", "total", "lang_total", "terms", F.lit(top).alias("top"))
    mine = counts.join(groups, ["lang", "source"]).withColumn("_s", F.explode(sides)).select("lang", "ord", "_s.*", "source", "tile", "n", F.lit(False).alias("whole"))
    whole = counts.groupBy("lang", "ord").agg(F.sum("n").alias("n")).join(per_lang, "lang").withColumn("left", F.explode(F.expr("sequence(0L, _tiles - 1)")))
    whole = whole.select("lang", "ord", "left", F.lit(0).cast("long").alias("right"), F.lit("").alias("source"), F.lit(-1).cast("long").alias("tile"), "n", F.lit(True).alias("whole"))
    cells = mine.unionByName(whole).withColumn("block", F.expr(f"ord div {BLOCK_TERMS}"))
    # New names for all columns, as both sides come from the same tables.
    infos = infos.toDF(*[f"{c}_" for c in infos.columns]).toDF(*infos.columns)
    keys = ("lang", "block", "left", "right")
    found = written(cells.groupBy(*keys).cogroup(infos.groupBy(*keys)).applyInPandas(_compare, "lang string, source string, other string, ord long, value long"), "audit-blocks")

    place = lambda tie: F.row_number().over(W.partitionBy("lang", "source").orderBy(F.desc("value"), tie)).cast("int").alias("rank")
    pairs = found.where("ord is null").groupBy("lang", "source", F.col("other").alias("item")).agg(F.sum("value").alias("value"))
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value", place("item"))
    best = found.where("ord is not null").withColumn("rank", place("ord")).where(F.col("rank") <= top)
    terms = best.join(kept, ["lang", "ord"]).select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value", "rank")
    return pairs.unionByName(terms)
