"""Secret scans: fixed detectors, and weak parts of credentials linked by an interval join (native)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import written

# The detectors of the contract.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"

#: Weak parts: a named identifier, a long mixed token, an address. None counts on its own.
WEAK_ID = r"""(?i)(?<![a-z0-9_])(?:user(?:name)?|login|client_?id|account|key_?id)["']?\x20*[:=]\x20*["']?[a-z0-9._@-]{3,64}"""
WEAK_SECRET = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}+={0,2}"
ENDPOINT = r"""(?i)(?<![a-z0-9])[a-z][a-z0-9+.-]{1,19}+://[^\x20\x09-\x0D"'<>]+"""

BASE_KINDS = ("assign", "access", "hex")
KINDS = (*BASE_KINDS, "id", "secret", "endpoint")

#: Code points between the starts of two parts of one credential, at most.
SCOPE = 400



def _no_spans() -> Column:
    return F.array().cast("array<struct<start:int,rank:int,end:int>>")


def _matches(text: Column, pattern: str, kind: str, keep: Callable[[Column, Column], Column] | None = None) -> Column:
    """Spans of all matches: gaps between matches and the matches themselves, added up left to right."""
    found, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    begin = F.struct(F.lit(0).alias("at"), _no_spans().alias("spans"))

    def step(state: Column, pair: Column) -> Column:
        start = state["at"] + F.char_length(pair["gap"])
        end = start + F.char_length(pair["match"])
        span = F.struct(start.alias("start"), F.lit(KINDS.index(kind)).alias("rank"), end.alias("end"))
        kept = F.concat(state["spans"], F.array(span))
        return F.struct(end.alias("at"), (F.when(keep(pair["match"]), kept).otherwise(state["spans"]) if keep else kept).alias("spans"))

    pairs = F.zip_with(F.slice(gaps, F.lit(1), F.size(found)), found, lambda g, m: F.struct(g.alias("gap"), m.alias("match")))
    return F.when(text.rlike(pattern), F.aggregate(pairs, begin, step, lambda s: s["spans"])).otherwise(_no_spans())


def _long_value(match: Column) -> Column:
    """Whether group 2 of an assignment has 8 characters; the match is its own leftmost match."""
    return F.char_length(F.regexp_extract(match, ASSIGN, 2)) >= 8


def _mixed(match: Column) -> Column:
    return match.rlike("[0-9]") & match.rlike("[a-z]") & match.rlike("[A-Z]")


def base_spans(text: Column) -> Column:
    """Spans of the fixed detectors by start, then kind as listed; null text has none."""
    text = F.coalesce(text, F.lit(""))
    access = F.when(F.contains(text, F.lit("AKIA")), _matches(text, ACCESS, "access")).otherwise(_no_spans())
    return F.array_sort(F.concat(_matches(text, ASSIGN, "assign", _long_value), access, _matches(text, HEX, "hex")))


def weak_spans(text: Column, base: Column) -> Column:
    """Weak parts that meet no base span."""
    text = F.coalesce(text, F.lit(""))
    parts = F.concat(_matches(text, WEAK_ID, "id"), _matches(text, WEAK_SECRET, "secret", _mixed), F.when(F.contains(text, F.lit("://")), _matches(text, ENDPOINT, "endpoint")).otherwise(_no_spans()))
    return F.filter(parts, lambda p: ~F.exists(base, lambda b: (b["start"] < p["end"]) & (p["start"] < b["end"])))


def _role(rank: Column) -> Column:
    """0 identifier, 1 secret, 2 endpoint."""
    return F.when(rank.isin(KINDS.index("access"), KINDS.index("id")), 0).when(rank == KINDS.index("endpoint"), 2).otherwise(1)


def linked(parts: DataFrame, scope: int = SCOPE) -> DataFrame:
    """(key, added): weak parts whose complements start within ``scope`` code points, per text.

    ``parts`` has one row per text: key, base and weak spans. A weak secret needs an identifier or an
    endpoint, a weak identifier needs a secret, an endpoint needs both. Complements are first reduced
    to the first and last start of each (text, role, bin of ``scope`` code points), so each weak part
    meets at most three rows of a role, however many parts a text has.
    """
    bin_of = lambda c: F.floor(c / scope)
    rows = parts.select("key", F.explode(F.concat(F.transform("base", lambda s: F.struct(s.alias("s"), F.lit(False).alias("weak"))), F.transform("weak", lambda s: F.struct(s.alias("s"), F.lit(True).alias("weak"))))).alias("p"))
    rows = rows.select("key", F.col("p.s").alias("s"), F.col("p.weak").alias("weak"), _role(F.col("p.s.rank")).alias("role"), F.col("p.s.start").alias("start"))
    sides = rows.groupBy("key", "role", bin_of(F.col("start")).alias("bin")).agg(F.min("start").alias("first"), F.max("start").alias("last"))
    asks = rows.where("weak").select("key", "s", F.col("role").alias("own"), "start", F.explode(F.array(*[bin_of(F.col("start")) + d for d in (-1, 0, 1)])).alias("bin"))
    near = (F.col("first") <= F.col("start") + scope) & (F.col("last") >= F.col("start") - scope)
    has = lambda role: F.max(F.when((F.col("role") == role) & near, 1).otherwise(0)) == 1
    met = asks.join(sides, ["key", "bin"]).groupBy("key", "s").agg(F.first("own").alias("own"), has(0).alias("with_id"), has(1).alias("with_secret"), has(2).alias("with_endpoint"))
    told = F.when(F.col("own") == 0, F.col("with_secret")).when(F.col("own") == 1, F.col("with_id") | F.col("with_endpoint")).otherwise(F.col("with_id") & F.col("with_secret"))
    return met.where(told).groupBy("key").agg(F.array_sort(F.collect_list("s")).alias("added"))


def _text_key(doc_id: str, text: str) -> Column:
    """A digest of id and text: rows equal in both share their result, other rows of one id do not."""
    return F.sha2(F.concat_ws("\x00", F.coalesce(F.col(doc_id).cast("string"), F.lit("-")), F.xxhash64(text).cast("string"), F.hash(text).cast("string")).cast("binary"), 256)


def find(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", scope: int = SCOPE) -> DataFrame:
    """One row per row of ``documents``: doc_id, key, base and added spans (start, rank in ``KINDS``, end).

    Spans are in code points, end exclusive, by start and then kind as listed. The texts are scanned
    once; what is shuffled afterwards are the spans of texts with weak parts of two roles. Null and
    empty texts have no spans; repeated rows stay; null ids are allowed; an empty table gives an empty
    result; extra columns are not read.
    """
    scanned = documents.select(F.col(doc_id).alias("doc_id"), _text_key(doc_id, text).alias("key"), base_spans(F.col(text)).alias("base"), F.col(text).alias("text"))
    scanned = written(scanned.select("doc_id", "key", "base", weak_spans(F.col("text"), F.col("base")).alias("weak")), "secret-parts")
    roles = F.size(F.array_distinct(F.transform(F.concat("base", "weak"), lambda s: _role(s["rank"]))))
    added = linked(scanned.where((F.size("weak") > 0) & (roles > 1)).dropDuplicates(["key"]), scope)
    return scanned.join(added, "key", "left").select("doc_id", "key", "base", F.coalesce("added", _no_spans()).alias("added"))


def all_spans(base: Column, added: Column) -> Column:
    return F.array_sort(F.concat(base, added))


def kind_of(rank: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, KINDS)), rank + 1)


def redact(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", length: str | None = "n_chars", mark: str = "[SECRET]") -> DataFrame:
    """``documents`` with every found span replaced by ``mark``; the columns stay, ``length`` is counted anew."""
    spans = find(documents, doc_id, text).where(F.size(F.concat("base", "added")) > 0).dropDuplicates(["key"]).select("key", all_spans(F.col("base"), F.col("added")).alias("_spans"))
    none = F.array().cast("array<struct<start:int,end:int>>")

    def merge(done: Column, s: Column) -> Column:
        last = F.element_at(done, -1)
        this = F.struct(s["start"].alias("start"), s["end"].alias("end"))
        joined = F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"))
        return F.when(F.size(done) == 0, F.array(this)).when(s["start"] < last["end"], F.concat(F.slice(done, 1, F.size(done) - 1), F.array(joined))).otherwise(F.concat(done, F.array(this)))

    keyed = documents.withColumn("_key", _text_key(doc_id, text)).join(spans.withColumnRenamed("key", "_key"), "_key", "left")
    apart = F.aggregate("_spans", none, merge)
    before = lambda i: F.when(i == 0, F.lit(0)).otherwise(F.get(F.col("_apart"), i - 1)["end"])
    pieces = F.transform("_apart", lambda s, i: F.concat(F.substring(F.col(text), before(i) + 1, s["start"] - before(i)), F.lit(mark)))
    rest = F.substr(F.col(text), F.element_at("_apart", -1)["end"] + 1)
    changed = keyed.withColumn("_apart", apart).withColumn(text, F.when(F.col("_apart").isNull(), F.col(text)).otherwise(F.concat(F.array_join(pieces, ""), rest)))
    if length in documents.columns:
        changed = changed.withColumn(length, F.when(F.col("_apart").isNull(), F.col(length)).otherwise(F.char_length(text).cast(documents.schema[length].dataType)))
    return changed.select(*documents.columns)
